"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule looks at counts of a whole text and votes good (1), bad (0) or abstains
(null).  Nobody labels anything: the share of good texts, and how often each rule votes rightly
and wrongly on good texts and on poor ones, are those that make the observed votes most likely, found by
expectation-maximisation over the table of vote patterns, which has at most
3^rules rows whatever the input.  A text is kept if it doesn't fail the base rules
and its posterior probability of being good is at least ``min_quality``.

Abstaining is evidence as well: a rule that votes on few texts at all is right if it votes where other rules find
fault too.  Accuracies alone can't tell which class is the poor one, and a rare fault can always be
explained as a rule that is wrong.  So rates start from, and are held by START_WEIGHT texts' worth of, what the
rules mean; a right vote stays likelier than a wrong one; and no rule is wrong, or silent, on less than
MIN_WRONG of a class, so one vote never settles a text by itself.

All is DataFrame and SQL functions.  A repeated window of words is found by
sorting the window hashes of a text with their positions and comparing the words
of neighbours in that order, so it takes n log n steps for n words.

Nulls: a missing text is an empty one: no words, so it fails the base rules.  Other
columns pass through untouched; repeated rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep
from .text import SPACES, free_name, whole, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Kept unless poor is twice as likely as good.
MIN_QUALITY = 1 / 3
ITERATIONS = 40
#: Where rates start: a rule's good votes on good and on poor texts, its bad votes on poor ones; and wrong bad votes, the least rate.
GOOD_RIGHT, GOOD_WRONG, BAD_RIGHT, MIN_WRONG = 0.7, 0.3, 0.3, 0.03
START_SHARE, START_WEIGHT = 0.8, 20
#: Fixed: characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Each rule: when it votes good, when bad; else it abstains.  Columns are those of ``features``.
#: A rule about one fault says nothing of the texts that don't have it, so most only ever vote bad.
RULES = {
    "prose": ("n_symbols = 0 AND 20 * n_letters >= 19 * word_chars AND 5 * n_capitals <= word_chars", "false"),
    "varied": ("20 * n_repeat_words <= n_words AND 10 * n_dup_lines <= n_lines AND 10 * n_symbols <= n_words", "false"),
    "word_length": ("false", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "symbols": ("false", "10 * n_symbols > n_words OR 25 * n_symbols > word_chars"),
    "letters": ("false", "10 * n_letters < 9 * word_chars"),
    "repeated_lines": ("false", "10 * n_dup_lines > 3 * n_lines"),
    "repeated_words": ("false", "5 * n_repeat_words > n_words"),
    "few_words": ("false", "10 * n_distinct_words < 3 * n_words"),
    "capitals": ("false", "2 * n_capitals > word_chars"),
    "shouting": ("false", "5 * n_shouts > n_words"),
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


#: Words covered by windows that occur twice or more.  ``w`` are the words, ``s`` the windows' hashes, the position in the low bits, sorted.
_COVERED = """
transform(array(CAST(ceil(log2(size(w) + 1)) AS INT)), bits ->
  transform(array(sort_array(transform(sequence(0, size(w) - {k}), i ->
      shiftleft(shiftrightunsigned(xxhash64({window_i}), bits), bits) | CAST(i AS BIGINT)))), s ->
    aggregate(
      sort_array(flatten(transform(
        filter(sequence(1, size(s) - 1), j ->
          shiftrightunsigned(s[j], bits) = shiftrightunsigned(s[j - 1], bits)
          AND exists(array(struct(CAST(s[j - 1] & (shiftleft(1L, bits) - 1) AS INT) AS a, CAST(s[j] & (shiftleft(1L, bits) - 1) AS INT) AS b)),
                     p -> {same_words})),
        j -> array(s[j - 1] & (shiftleft(1L, bits) - 1), s[j] & (shiftleft(1L, bits) - 1))))),
      struct(0L AS covered, 0L AS up_to),
      (x, p) -> struct(x.covered + p + {k}L - greatest(x.up_to, p) AS covered, p + {k}L AS up_to),
      x -> x.covered))[0])[0]
"""


def repeated_words(of: str, window: int = 3) -> Column:
    """Number of words of the array ``of`` in ``window``-word windows that occur twice or more."""
    body = _COVERED.format(
        k=window,
        window_i=", ".join(f"w[i + {d}]" for d in range(window)),
        same_words=" AND ".join(f"w[p.a + {d}] = w[p.b + {d}]" for d in range(window)),
    )
    return F.expr(f"transform(array({of}), w -> CASE WHEN size(w) <= {window} THEN 0L ELSE {body} END)[0]")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that base rules and voting rules look at (names in BASE and MORE)."""
    body = whole(f"`{text}`")
    w, n, bare = (free_name(docs, x) for x in ("_words", "_lines", "_bare"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({w: words(body), n: lines, bare: _without(body, SPACES)})
    count = lambda characters: (F.char_length(bare) - F.char_length(_without(F.col(bare), characters))).cast("long")
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": (F.size(n) - F.size(F.array_distinct(n))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_lines": F.size(n).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
        "n_capitals": count(CAPITALS),
        "n_shouts": count("!?"),
        "n_letters": count(NO_LETTERS),
    })
    return out.drop(w, n, bare).withColumn("n_letters", F.col("word_chars") - F.col("n_letters"))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÚÛÜ"
NO_LETTERS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_capitals", "n_shouts", "n_letters"]


def votes(rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """The votes as one text: a character per rule, 1, 0 or - for none."""
    return F.concat(*[F.expr(f"CASE WHEN {good} THEN '1' WHEN {bad} THEN '0' ELSE '-' END") for good, bad in rules.values()])


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")


def sides(rules: dict[str, tuple[str, str]] = RULES) -> list[tuple[bool, bool]]:
    """For each rule, whether it ever votes good and whether it ever votes bad."""
    return [(good != "false", bad != "false") for good, bad in rules.values()]


def pattern_quality(patterns: DataFrame, sides: list[tuple[bool, bool]], iterations: int = ITERATIONS) -> DataFrame:
    """``votes``, ``quality`` for a table of ``votes``, ``n``: the model fitted to them.

    The model: a text is good with probability ``share``; rule j then votes good or bad, or not, with rates that
    depend on the class alone (g: of good texts, b: of poor ones; 1: good votes, 0: bad ones).
    """
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("t"))
    starts = ", ".join(
        f"struct({GOOD_RIGHT if good else 0}D AS g1, {GOOD_WRONG if good else 0}D AS b1, {BAD_RIGHT if bad else 0}D AS b0, {MIN_WRONG if bad else 0}D AS g0)"
        for good, bad in sides
    )
    silent = lambda one, zero: f"greatest({MIN_WRONG}D, 1D - r.{one} - r.{zero})"
    odds = f"""ln(m.share / (1 - m.share)) + aggregate(m.rates, struct(0D AS x, 1 AS j), (a, r) -> struct(a.x + CASE substr(p.votes, a.j, 1)
        WHEN '1' THEN ln(r.g1 / r.b1) WHEN '0' THEN ln(r.g0 / r.b0) ELSE ln({silent("g1", "g0")} / {silent("b1", "b0")}) END AS x, a.j + 1 AS j)).x"""
    posterior = f"transform(t, p -> struct(p.votes AS votes, p.n AS n, 1D / (1D + exp(-({odds}))) AS q))"

    def rate(start: str, vote: str, share: str, least: str) -> str:
        """Of the texts of a class the share that a rule votes so on, START_WEIGHT texts of its start added; 0 if it never does."""
        counted = f"aggregate(posterior, 0D, (x, p) -> x + CASE WHEN substr(p.votes, j + 1, 1) = '{vote}' THEN p.n * {share} ELSE 0D END)"
        of = f"aggregate(posterior, 0D, (x, p) -> x + p.n * {share})"
        return f"CASE WHEN s.{start} = 0 THEN 0D ELSE greatest({least}, ({START_WEIGHT} * s.{start} + {counted}) / ({START_WEIGHT} + {of})) END"

    good, poor = "p.q", "(1 - p.q)"
    wrong = f"struct({rate('b1', '1', poor, f'{MIN_WRONG}D')} AS b1, {rate('g0', '0', good, f'{MIN_WRONG}D')} AS g0)"
    rates = f"""transform(array({starts}), (s, j) -> transform(array({wrong}), w -> struct({rate("g1", "1", good, "w.b1")} AS g1, w.b1 AS b1,
        {rate("b0", "0", poor, "w.g0")} AS b0, w.g0 AS g0))[0])"""
    step = f"""transform(array({posterior}), posterior -> struct(
        (10 * {START_SHARE}D + aggregate(posterior, 0D, (x, p) -> x + p.n * p.q)) / (10 + aggregate(posterior, 0D, (x, p) -> x + p.n)) AS share,
        {rates} AS rates))[0]"""
    start = f"struct({START_SHARE}D AS share, array({starts}) AS rates)"
    fitted = table.withColumn("m", F.expr(f"aggregate(sequence(1, {iterations}), {start}, (m, i) -> {step})"))
    return fitted.select(F.explode(F.expr(posterior)).alias("p")).select("p.votes", F.col("p.q").alias("quality"))


def judge(
    docs: DataFrame,
    rules: dict[str, tuple[str, str]] = RULES,
    min_quality: float = MIN_QUALITY,
    iterations: int = ITERATIONS,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``votes``, ``quality`` and ``kept``; ``text`` goes unless it is kept.

    Columns of ``docs`` with one of those names are replaced.
    """
    clashing = {c.lower() for c in [*BASE, *MORE, "base_failed", "votes", "quality", "kept"]}
    mine = docs.drop(*[c for c in docs.columns if c.lower() in clashing and c != "text"])
    rated = features(mine).withColumns({"base_failed": base_failed(), "votes": votes(rules)}).drop(*MORE)
    rated = keep(rated if keep_text else rated.drop("text"), "rated")
    patterns = rated.groupBy("votes").agg(F.count("*").alias("n"))
    qualities = keep(pattern_quality(patterns, sides(rules), iterations), "qualities")
    # at most 3^rules rows
    return rated.join(F.broadcast(qualities), "votes").withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= min_quality)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns only."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    return judge(numbered, keep_text=False).where("kept").select("_row.*")
