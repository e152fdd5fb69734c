"""Text to terms, with native array functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlane.functions.clean import SPACES

HAN = r"\x{4e00}-\x{9fff}"
# A run of Chinese characters, or a run of other letters, digits and '_'; two or more of them.
WORD = rf"([{HAN}]{{2,}}|(?:[^\P{{L}}{HAN}]|[\p{{N}}_]){{2,}})"


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.split(text, "")


def gap_words(text: Column) -> Column:
    """Lower-cased words with one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))


def adjacent(items: Column, joiner: str = "") -> Column:
    """Each item joined to the next one."""
    n = F.size(items)
    pairs = F.zip_with(items, F.slice(items, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat(a, F.lit(joiner), b))
    return F.slice(pairs, 1, F.greatest(n - 1, F.lit(0)))


def word_tokens(text: Column) -> Column:
    """Words of two characters and more; Chinese runs become character pairs."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))
    return F.flatten(
        F.transform(
            runs,
            lambda run: F.when(run.rlike(f"^[{HAN}]"), adjacent(characters(run))).otherwise(F.array(run)),
        )
    )


CHUNK = 64


def grams(text: Column, length: Column | int) -> Column:
    """Every substring of ``length`` characters; an empty array if there is none.

    Characters of a string are found by counting from its start, so the text is
    cut into short overlapping chunks first: the cost stays near linear for long texts.
    """
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.sequence(F.lit(1), F.length(text) - length + 1, F.lit(CHUNK))
    chunks = F.transform(starts, lambda s: F.substr(text, s, length + (CHUNK - 1)))
    pieces = F.transform(
        chunks,
        lambda c: F.transform(
            F.sequence(F.lit(1), F.length(c) - length + 1), lambda i: F.substr(c, i, length)
        ),
    )
    return F.when(F.length(text) >= length, F.flatten(pieces)).otherwise(F.array().cast("array<string>"))
