"""Cleaning functions, each ``Column -> Column`` and free of Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlane.constants import MAX_TAGS, TAG_RULES

# All Unicode white space, spelled out: the short class \s covers ASCII only in
# the regular expressions of the JVM, and would leave the ideographic space.
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE}]+"
MAYBE_SPACES = f"[{SPACE}]*"

ADDRESS = f"地址[：:]{MAYBE_SPACES}([^\\n电话官网]+)"
ADDRESS_TO_LABEL = f"地址[：:]{MAYBE_SPACES}([^\\n]+?){MAYBE_SPACES}(?:电话[：:]|官网[：:]|\\n|$)"
PHONE = f"电话[：:]{MAYBE_SPACES}([\\p{{Nd}}\\-,，{SPACE}]+)"
WEBSITE = f"官网[：:]{MAYBE_SPACES}(https?://[^{SPACE}]+)"
NAME_HEAD = r"^([\x{4e00}-\x{9fa5}·（）()\p{Nd}]+)"
PRICE = r"¥(\p{Nd}+)"
HOURS = f"(\\p{{Nd}}{{1,2}}[：:]\\p{{Nd}}{{2}}{MAYBE_SPACES}[-至到]{MAYBE_SPACES}\\p{{Nd}}{{1,2}}[：:]\\p{{Nd}}{{2}})"
NUMBER = r"^[ \t\n\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r]*$"
DURATION_LABEL = f"建议游览时间[：:]?{MAYBE_SPACES}"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACES}|{SPACES}$", "")


def clean_text(c: Column) -> Column:
    """Runs of white space become one space, ends are stripped, null becomes ''."""
    return F.trim(F.regexp_replace(_text(c), SPACES, " "))


def extract_address(c: Column, strict_labels: bool = False) -> Column:
    """The text behind the address label, or the whole cleaned text without one.

    By default the address ends at any of the four characters of the following
    labels, wherever they occur; ``strict_labels`` ends it at a whole label.
    """
    found = F.regexp_extract(_text(c), ADDRESS_TO_LABEL if strict_labels else ADDRESS, 1)
    return F.when(found != "", clean_text(found)).otherwise(clean_text(c))


def extract_phone(c: Column) -> Column:
    """Numbers behind the phone label, separated by commas."""
    found = F.regexp_extract(_text(c), PHONE, 1)
    return F.regexp_replace(F.regexp_replace(found, f"[，{SPACE}]+", ","), "^,+|,+$", "")


def extract_website(c: Column) -> Column:
    """The http(s) address behind the site label, else ''."""
    return F.regexp_extract(_text(c), WEBSITE, 1)


def clean_name(c: Column) -> Column:
    """The leading run of Chinese characters, digits and brackets, else all of it."""
    head = F.regexp_extract(_text(c), NAME_HEAD, 1)
    return F.when(head != "", clean_text(head)).otherwise(clean_text(c))


def range_number(c: Column, low: float, high: float) -> Column:
    """A number within [low, high]; anything else, nan included, is null."""
    text = _text(c)
    value = F.when(text.rlike(NUMBER), F.trim(F.translate(text, "\t\n\r", "   ")).try_cast("double"))
    return F.when(value.between(low, high), value)


def clean_rating(c: Column) -> Column:
    return range_number(c, 0.0, 5.0)


def price_floor(c: Column) -> Column:
    """The lowest price as ``¥n起``, or ``免费``, or the cleaned text."""
    text = _text(c)
    ascii_digits = F.translate(text, "０１２３４５６７８９", "0123456789")
    # numbers of any length: without leading zeros the shorter one is less
    prices = F.transform(
        F.regexp_extract_all(ascii_digits, F.lit(PRICE), F.lit(1)),
        lambda p: F.struct(F.length(F.ltrim(p, F.lit("0"))).alias("n"), F.ltrim(p, F.lit("0")).alias("digits")),
    )
    lowest = F.array_min(prices)["digits"]
    cleaned = clean_text(text)
    return (
        F.when(F.size(prices) > 0, F.concat(F.lit("¥"), F.when(lowest == "", F.lit("0")).otherwise(lowest), F.lit("起")))
        .when(text.contains("免费"), F.lit("免费"))
        .when(cleaned == "nan", F.lit(""))
        .otherwise(cleaned)
    )


def clean_open_time(c: Column, long: int = 100) -> Column:
    """Texts longer than ``long`` are cut down to their first opening hours."""
    cleaned = clean_text(c)
    hours = F.regexp_extract(cleaned, HOURS, 1)
    is_long = F.length(cleaned) > long
    return (
        F.when(is_long & (hours != ""), hours)
        .when(is_long & cleaned.contains("全天"), F.lit("全天开放"))
        .when(cleaned == "nan", F.lit(""))
        .otherwise(cleaned)
    )


def clean_suggest_time(c: Column) -> Column:
    return clean_text(F.regexp_replace(_text(c), DURATION_LABEL, ""))


def tag_array(text: Column, rules: dict[str, list[str]] = TAG_RULES, limit: int = MAX_TAGS) -> Column:
    """Tags of every rule whose keyword occurs, in rule order, without repeats."""
    per_rule = [
        F.when(text.contains(keyword), F.array(*[F.lit(t) for t in tags]))
        .otherwise(F.array().cast("array<string>"))
        for keyword, tags in rules.items()
    ]
    return F.slice(F.array_distinct(F.flatten(F.array(*per_rule))), 1, limit)


def extract_tags(name: Column, intro: Column) -> Column:
    return F.array_join(tag_array(F.concat(_text(name), _text(intro))), "|")


def truncate_text(c: Column, length: int = 500) -> Column:
    """Cleaned text; beyond ``length`` characters it is cut and marked with '...'."""
    cleaned = clean_text(c)
    return F.when(F.length(cleaned) > length, F.concat(F.substring(cleaned, 1, length), F.lit("..."))).otherwise(cleaned)


def preview(c: Column, length: int = 500) -> Column:
    """As it stands (no cleaning) up to ``length`` characters."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def percent(score: Column, digits: int = 1) -> Column:
    return F.round(score * 100, digits)


def clamp_confidence(c: Column) -> Column:
    return F.least(c, F.lit(1.0))
