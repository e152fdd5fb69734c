"""The operators' registered queries: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    archive, chat, compression, interpolated_lm, mixing, near_copies, packing, pivot_search, prefix_trie, quality_rules, repeats, spelling,
    toxicity,
)
from .learn import learnable
from .text import n_words, remainder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, learnable(_table(spark, folder, "labels")))
    return _predicted(toxicity.score(docs, model), toxicity.THRESHOLD)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(_table(spark, folder, "conversations")).drop("position")


def op4_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), pivot_search.quantised(F.col("embedding")).alias("x")
    )
    vectors = vectors.where("id IS NOT NULL AND x IS NOT NULL")
    return pivot_search.search(vectors, vectors.where("id % 50 = 0"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    sized = docs.select("doc_id", n_words("text").alias("words"))
    return packing.pack(sized, F.col("words")).drop("words")


def op6_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = compression.fit(docs, learnable(_table(spark, folder, "labels")))
    return _predicted(compression.score(docs, model), compression.THRESHOLD)


def op7_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive.archive_round_trip(_table(spark, folder, "pages")).drop("number")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    sized = docs.select("doc_id", "source", n_words("text").alias("words"))
    return mixing.mix(sized, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op9_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.score(_table(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, folder, "documents"))


def op11_superkmers(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat": op3_chat,
    "op4_pivot_search": op4_pivot_search,
    "op5_packing": op5_packing,
    "op6_compression": op6_compression,
    "op7_archive": op7_archive,
    "op8_mixing": op8_mixing,
    "op9_interpolated_lm": op9_interpolated_lm,
    "op10_simhash": op10_simhash,
    "op11_superkmers": op11_superkmers,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"

BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: The table of crc32 in ``crc(t)``, a row.
CRC_TABLE = """crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 of a column beside ``crc``."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def _quality_oracle() -> str:
    """Counts by plain joins and windows; the model's rounds as a recursive table of one row a round."""
    rules, n = quality_rules.RULES, len(quality_rules.RULES)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    left = lambda characters: f"length(translate(bare, {quoted(characters)}, ''))"
    votes = " || ".join(f"CASE WHEN {good} THEN '1' WHEN {bad} THEN '0' ELSE '-' END" for good, bad in rules.values())
    sides, least, weight = quality_rules.sides(), quality_rules.MIN_WRONG, quality_rules.START_WEIGHT
    silent = lambda one, zero, j: f"greatest({least}, 1 - {one}[{j}] - {zero}[{j}])"
    odds = "ln(share / (1 - share))" + "".join(
        f" + CASE substr(votes, {j}, 1) WHEN '1' THEN ln(g1[{j}] / b1[{j}]) WHEN '0' THEN ln(g0[{j}] / b0[{j}])"
        f" ELSE ln({silent('g1', 'g0', j)} / {silent('b1', 'b0', j)}) END"
        for j in range(1, n + 1)
    )
    starts = {
        "g1": [quality_rules.GOOD_RIGHT * good for good, _ in sides], "b1": [quality_rules.GOOD_WRONG * good for good, _ in sides],
        "b0": [quality_rules.BAD_RIGHT * bad for _, bad in sides], "g0": [least * bad for _, bad in sides],
    }

    def rates(name: str) -> str:
        vote, share = name[1], "q" if name[0] == "g" else "(1 - q)"
        one = lambda j, start, floor: (
            f"greatest({floor}, ({weight} * {start} + sum(CASE WHEN substr(votes, {j}, 1) = '{vote}' THEN n * {share} ELSE 0 END)) / ({weight} + sum(n * {share})))"
            if start else "0::DOUBLE"
        )
        return "[" + ", ".join(one(j, start, least) for j, start in enumerate(starts[name], 1)) + "]"

    above = lambda right, wrong: "[" + ", ".join(f"greatest({right}[{j}], {wrong}[{j}])" for j in range(1, n + 1)) + "]"
    listed = ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in starts[name]) + f"] AS {name}" for name in starts)
    return f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
                translate(coalesce(text, ''), {BLANKS}, '') AS bare,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS lines
            FROM documents),
        windows AS (
            SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM windows) WHERE k > 1),
        covered AS (
            SELECT r, count(DISTINCT i + x) AS k FROM repeated, (VALUES (0), (1), (2)) t(x) GROUP BY r),
        counts AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars,
                (length(bare) - {left(quality_rules.SYMBOLS)})::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(covered.k, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
                len(list_distinct(w)) AS n_distinct_words, length(bare) - {left(quality_rules.CAPITALS)} AS n_capitals,
                length(bare) - {left("!?")} AS n_shouts, {left(quality_rules.NO_LETTERS)} AS n_letters
            FROM d LEFT JOIN covered USING (r)),
        voted AS (SELECT *, {votes} AS votes FROM counts),
        patterns AS (SELECT votes, count(*)::DOUBLE AS n FROM voted GROUP BY votes),
        model AS (
            SELECT 0 AS i, {quality_rules.START_SHARE}::DOUBLE AS share, {listed}
            UNION ALL
            SELECT i, share, {above("g1", "b1")}, b1, {above("b0", "g0")}, g0 FROM (
                SELECT i + 1 AS i, (10 * {quality_rules.START_SHARE} + sum(n * q)) / (10 + sum(n)) AS share,
                    {", ".join(f"{rates(name)} AS {name}" for name in starts)}
                FROM (SELECT i, votes, n, 1 / (1 + exp(-({odds}))) AS q FROM model, patterns WHERE i < {quality_rules.ITERATIONS})
                GROUP BY i)),
        rated AS (
            SELECT votes, 1 / (1 + exp(-({odds}))) AS quality FROM patterns, model WHERE i = {quality_rules.ITERATIONS})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
            NOT failed AND quality >= {quality_rules.MIN_QUALITY} AS kept
        FROM (SELECT *, n_words < {quality_rules.MIN_WORDS}
                OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS failed FROM voted)
        JOIN rated USING (votes)
    """


ORACLE: dict[str, str] = {
    "op2_quality_rules": _quality_oracle(),
    "op4_pivot_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5
    """,
    "op7_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        hex AS (SELECT html, sha1(html) AS d FROM (SELECT DISTINCT html FROM p)),
        digest AS (
            SELECT html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' ORDER BY i) AS digest
            FROM (
                SELECT html, i, list_sum(list_transform(range(0, 5), lambda b:
                    (((strpos('0123456789abcdef', substr(d, ((5 * i + b) // 4)::INT + 1, 1)) - 1)
                      >> (3 - (5 * i + b) % 4)::INT) & 1) * (1 << (4 - b)::INT)))::INT AS v
                FROM hex, range(0, 32) t(i))
            GROUP BY html)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p) JOIN digest USING (html)
    """,
    "op8_mixing": f"""
        WITH d AS (
            SELECT doc_id, source, len({WORDS})::BIGINT AS size,
                ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
            FROM d GROUP BY source),
        filled AS (
            SELECT *, sum(w) OVER (ORDER BY source_size / w DESC, w, source) AS open_weight,
                (SELECT sum(source_size) FROM s)
                    - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, w DESC, source DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_words
            FROM s),
        level AS (
            SELECT arg_min(open_words, source_size / w) AS open_words, arg_min(open_weight, source_size / w) AS open_weight
            FROM filled WHERE w * open_words <= 3 * source_size * open_weight),
        t AS (
            SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE
                least(w * open_words::BIGINT / open_weight::BIGINT, 3 * source_size) END::DOUBLE AS target
            FROM s, level),
        cells AS (
            SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) / 2 AS middle
            FROM d GROUP BY source, h),
        picked AS (
            SELECT cells.source, cells.h, middle < target - floor(target / source_size) * source_size AS more
            FROM cells JOIN t ON cells.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
            CASE WHEN source_size = 0 THEN 0 ELSE
                size * least(3, floor(target / source_size)::BIGINT + more::BIGINT) END::BIGINT AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        JOIN picked ON picked.source IS NOT DISTINCT FROM d.source AND picked.h = d.h
    """,
    "op11_superkmers": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        windows AS (
            SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS k FROM windows) WHERE k > 1),
        gone AS (SELECT DISTINCT r, i + x AS i FROM repeated, range(35) t(x)),
        kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
            FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
    "op12_spelling": f"""
        WITH RECURSIVE {CRC_TABLE},
        tokens AS (
            SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        lowered AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, n FROM (
                SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                FROM tokens GROUP BY ALL)),
        hashed AS (SELECT run, n, {_crc32("key")} AS h FROM lowered, crc),
        counts AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
                FROM hashed)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM counts, range(1, length(word) + 1) t(i)),
        pairs AS (
            SELECT x.word, y.word AS other, y.n AS other_n FROM gaps x JOIN gaps y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
            UNION SELECT c.word, g.word, g.n FROM counts c JOIN gaps g ON c.word = g.a || g.z
            UNION SELECT g.word, c.word, c.n FROM counts c JOIN gaps g ON c.word = g.a || g.z),
        near AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
        best AS (SELECT word, top, min(other) AS other FROM pairs JOIN near USING (word) WHERE other_n = top GROUP BY word, top),
        formed AS (
            SELECT c.word, CASE WHEN top >= 2 * c.n THEN other END AS form, c.n, coalesce(n_near, 0)::BIGINT AS n_near,
                CASE WHEN top >= 2 * c.n THEN top END AS form_n
            FROM counts c LEFT JOIN near USING (word) LEFT JOIN best USING (word, top)),
        walk AS (
            SELECT word, word AS at, form AS next FROM formed
            UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON walk.next = formed.word)
        SELECT formed.word, formed.form, walk.at AS root, n, n_near, form_n FROM formed JOIN walk ON formed.word = walk.word AND walk.next IS NULL
    """,
    "op13_prefix_trie": f"""
        WITH {CRC_TABLE},
        own AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
            FROM conversations),
        ids AS (SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS c, count(*) AS n FROM own GROUP BY conv_id),
        hashed AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, CASE WHEN conv_id IS NULL THEN 0 ELSE {_crc32("c")} % 4 END AS h FROM ids, crc),
        convs AS (SELECT x.conv_id, x.h, x.base, least(x.h, coalesce(y.n, 0)) AS given FROM hashed x LEFT JOIN hashed y ON x.base = y.conv_id),
        turns AS (
            SELECT c.conv_id, pos - h + given AS pos, role, text FROM own JOIN convs c ON own.conv_id IS NOT DISTINCT FROM c.conv_id WHERE pos >= h
            UNION ALL SELECT c.conv_id, pos, role, text FROM own JOIN convs c ON own.conv_id = c.base WHERE pos < given),
        lists AS (
            SELECT c.conv_id, list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL) AS turns
            FROM convs c LEFT JOIN turns t ON c.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY c.conv_id),
        sequences AS (SELECT conv_id, coalesce(turns, []) AS turns FROM lists),
        paths AS (
            SELECT conv_id, turns[1:d] AS node, d, d = len(turns) AS last FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM sequences)),
        nodes AS (
            SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends
            FROM paths GROUP BY node, d),
        linked AS (SELECT *, node[1:depth - 1] AS parent FROM nodes),
        children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
        own_values AS (
            SELECT l.*, coalesce(n_children, 0) AS n_children,
                CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len({WORDS.replace("coalesce(text, '')", "node[depth].text")}) END AS saved
            FROM linked l LEFT JOIN children USING (node, depth)),
        totals AS (
            SELECT node[1:a] AS node, a AS depth, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
            FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM own_values) GROUP BY ALL)
        SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves, saved_tokens,
            sha256(coalesce(v.ends, '')) AS ends_sha256
        FROM own_values v JOIN totals USING (node, depth) LEFT JOIN nodes p ON p.node = v.parent AND p.depth = v.depth - 1
    """,
}
