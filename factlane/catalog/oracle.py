"""The same results in DuckDB's SQL, for checking.

Written for clarity: plain joins and windows, no blocking, no partial results.
"""

from __future__ import annotations

from factlane import constants as C
from factlane.catalog.queries import OTHER_CITY, PART_REPAIR_CITY, PART_REPAIRS, PROSE_TAGS, RAW_SHORT
from factlane.catalog.views import KB, QUESTIONS, RAW_RENAMES, RAW_ROWS, REQUESTS, TURNS
from factlane.config import ClassifierConfig, RetrievalConfig
from factlane.functions.render import fields_of
from factlane.training_set import TRAINING_TEXTS

ORACLE: dict[str, str] = {}


def lit(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(name: str, columns: str, rows) -> str:
    listed = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {listed})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def template(text: str, columns: dict[str, str]) -> str:
    """A template as a concatenation of literals and columns."""
    parts, rest = [], text
    for field in fields_of(text):
        before, rest = rest.split("{" + field + "}", 1)
        if before:
            parts.append(lit(before))
        parts.append(columns[field])
    if rest:
        parts.append(lit(rest))
    return "(" + " || ".join(parts) + ")"


KB_CTE = f"kb AS ({KB})"
QUESTIONS_CTE = f"questions AS ({QUESTIONS})"
REQUESTS_CTE = f"requests AS ({REQUESTS})"
RAW_CTE = f"raw_rows AS ({RAW_ROWS})"
# The patterns, written out once more from what the fields look like, not taken from the code they check.
BLANK = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLANKS = f"[{BLANK}]*"
WS = lit(f"[{BLANK}]+")
CHINESE = "一-鿿"
TOKEN = f"([{CHINESE}]{{2,}}|(?:[^\\PL{CHINESE}]|[\\pN_]){{2,}})"
ADDRESS_FIELD = f"地址(?:：|:){BLANKS}([^\n电话官网]+)"
PHONE_FIELD = f"电话(?:：|:){BLANKS}([-\\p{{Nd}},，{BLANK}]+)"
WEBSITE_FIELD = f"官网(?:：|:){BLANKS}(https?://[^{BLANK}]+)"
LEADING_NAME = "^((?:[一-龥]|[·（）()]|\\p{Nd})+)"
CLOCK = "\\p{Nd}{1,2}(?:：|:)\\p{Nd}{2}"
OPENING_HOURS = f"({CLOCK}{BLANKS}(?:-|至|到){BLANKS}{CLOCK})"
DURATION = f"建议游览时间(?:：|:)?{BLANKS}"


# --- cleaning ----------------------------------------------------------------


def text_(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {WS}, ' ', 'g'))"


def address(c: str) -> str:
    found = f"regexp_extract(coalesce({c}, ''), {lit(ADDRESS_FIELD)}, 1)"
    return f"CASE WHEN {found} <> '' THEN {text_(found)} ELSE {text_(c)} END"


def phone(c: str) -> str:
    found = f"regexp_extract(coalesce({c}, ''), {lit(PHONE_FIELD)}, 1)"
    return f"trim(regexp_replace({found}, {lit(f'[，{BLANK}]+')}, ',', 'g'), ',')"


def website(c: str) -> str:
    return f"regexp_extract(coalesce({c}, ''), {lit(WEBSITE_FIELD)}, 1)"


def head_name(c: str) -> str:
    found = f"regexp_extract(coalesce({c}, ''), {lit(LEADING_NAME)}, 1)"
    return f"CASE WHEN {found} <> '' THEN {text_(found)} ELSE {text_(c)} END"


def number(c: str, low, high) -> str:
    value = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"CASE WHEN {value} BETWEEN {low} AND {high} THEN {value} END"


def price(c: str) -> str:
    prices = f"list_transform(regexp_extract_all(coalesce({c}, ''), '¥([0-9]+)', 1), lambda p: CAST(p AS HUGEINT))"
    return (
        f"CASE WHEN len({prices}) > 0 THEN '¥' || CAST(list_min({prices}) AS VARCHAR) || '起' "
        f"WHEN contains(coalesce({c}, ''), '免费') THEN '免费' WHEN {text_(c)} = 'nan' THEN '' ELSE {text_(c)} END"
    )


def hours(c: str) -> str:
    found = f"regexp_extract({text_(c)}, {lit(OPENING_HOURS)}, 1)"
    return (
        f"CASE WHEN length({text_(c)}) > 100 AND {found} <> '' THEN {found} "
        f"WHEN length({text_(c)}) > 100 AND contains({text_(c)}, '全天') THEN '全天开放' "
        f"WHEN {text_(c)} = 'nan' THEN '' ELSE {text_(c)} END"
    )


def duration(c: str) -> str:
    return text_(f"regexp_replace(coalesce({c}, ''), {lit(DURATION)}, '', 'g')")


def cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


def tags_of(source: str, key: str, text: str, rules: dict[str, list[str]], limit: int = C.MAX_TAGS) -> str:
    """A statement giving (key, tags) for every row of ``source``."""
    listed = [(p, i, k, tag) for p, (k, tags) in enumerate(rules.items()) for i, tag in enumerate(tags)]
    return f"""
    (WITH {values('rules', 'pos, nth, keyword, tag', listed)},
     hits AS (SELECT {key} AS k, tag, min(pos * 10 + nth) AS place FROM {source}, rules
              WHERE contains({text}, keyword) GROUP BY ALL),
     kept AS (SELECT k, tag, place, row_number() OVER (PARTITION BY k ORDER BY place) AS n FROM hits),
     joined AS (SELECT k, string_agg(tag, '|' ORDER BY place) AS tags FROM kept WHERE n <= {limit} GROUP BY k)
     SELECT {key}, coalesce(tags, '') AS tags FROM {source} LEFT JOIN joined ON {key} = k)"""


def raw(select: str) -> str:
    return f"{with_(RAW_CTE)} SELECT ord, {select} FROM raw_rows"


ORACLE["clean_text"] = raw(f"{text_('raw_name')} AS name, {text_('raw_tips')} AS tips")
ORACLE["extract_labelled"] = raw(f"{address('raw_address')} AS address")
ORACLE["extract_phone"] = raw(f"{phone('raw_address')} AS phone")
ORACLE["extract_url_host"] = (
    "SELECT page_id, url AS website, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"
)
ORACLE["leading_name"] = raw(f"{head_name('raw_name')} AS name")
ORACLE["range_cast"] = (
    f"SELECT event_id, {number(chr(39).join(['json_extract_string(props, ', '$.k', ')']), 0, 50)} AS k FROM events"
)
ORACLE["clean_rating"] = raw(f"{number('raw_rating', 0, 5)} AS rating")
ORACLE["price_floor"] = raw(f"{price('raw_ticket')} AS price")
ORACLE["open_time"] = raw(f"{hours('raw_open')} AS open_time")
ORACLE["strip_label"] = raw(f"{duration('raw_suggest')} AS suggest_time")
ORACLE["keyword_tags"] = tags_of("documents", "doc_id", "text", PROSE_TAGS).strip()[1:-1]
RAW_TEXT = "coalesce(raw_name, '') || coalesce(raw_intro, '')"
ORACLE["attraction_tags"] = f"{with_(RAW_CTE)} SELECT * FROM {tags_of('raw_rows', 'ord', RAW_TEXT, C.TAG_RULES)}"
ORACLE["truncate_text"] = (
    f"SELECT doc_id, {cut('text', 500)} AS text FROM (SELECT doc_id, {text_('text')} AS text FROM documents)"
)

PROVINCES_CTE = values("provinces", "city, province", C.CITY_PROVINCE.items())
ORACLE["kb_build"] = f"""{with_(RAW_CTE, PROVINCES_CTE)},
tagged AS (SELECT * FROM {tags_of('raw_rows', 'ord', RAW_TEXT, C.TAG_RULES)}),
cleaned AS (
  SELECT raw_rows.ord, {head_name('raw_name')} AS name, city, {address('raw_address')} AS address,
         {phone('raw_address')} AS phone, {website('raw_address')} AS website, {number('raw_rating', 0, 5)} AS rating,
         {price('raw_ticket')} AS ticket_price, {hours('raw_open')} AS open_time,
         {duration('raw_suggest')} AS suggest_time, tags, {cut(text_('raw_intro'), 500)} AS description,
         {text_('raw_tips')} AS tips
  FROM raw_rows JOIN tagged ON raw_rows.ord = tagged.ord),
firsts AS (SELECT *, row_number() OVER (PARTITION BY name, city ORDER BY ord) AS n FROM cleaned WHERE name <> '')
SELECT row_number() OVER (ORDER BY ord) AS dataid, name, firsts.city AS city, coalesce(province, '') AS province,
       address, phone, website, rating, ticket_price, open_time, suggest_time, tags, description, tips
FROM firsts LEFT JOIN provinces ON firsts.city = provinces.city WHERE n = 1"""

# --- rows, lookups, statistics -----------------------------------------------

ORACLE["dim_lookup"] = f"""{with_(RAW_CTE, PROVINCES_CTE)}
SELECT ord, raw_rows.city AS city, coalesce(province, '') AS province
FROM raw_rows LEFT JOIN provinces ON raw_rows.city = provinces.city"""

REPAIRED = f"""{with_(RAW_CTE, values('mapping', 'old_value, new_value', PART_REPAIRS.items()))},
repaired AS (
  SELECT ord, city, CASE WHEN new_value IS NOT NULL THEN new_value ELSE p_name END AS name,
         new_value IS NOT NULL AS repaired
  FROM raw_rows JOIN part ON ord = p_partkey
  LEFT JOIN mapping ON city = {lit(PART_REPAIR_CITY)} AND p_name = old_value)"""
ORACLE["value_repair"] = f"{REPAIRED} SELECT ord, city, name, repaired FROM repaired"
ORACLE["value_repair_count"] = (
    f"{REPAIRED} SELECT count(*) FILTER (WHERE repaired) AS n_repaired, count(*) AS n_rows FROM repaired"
)
ORACLE["union_missing_columns"] = """
SELECT s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer"""
ORACLE["dedupe_first"] = """
SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)"""
ORACLE["dense_ids"] = "SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS position, doc_id FROM documents"
ORACLE["head_rows"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 5"
TOP_RATED = """top_rated AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY rating DESC NULLS LAST, dataid) AS rank FROM kb)
  WHERE rank <= 3)"""
ORACLE["topk_per_group"] = (
    f"{with_(KB_CTE, TOP_RATED)} SELECT city, CAST(rank AS INTEGER) AS rank, dataid, name, rating FROM top_rated"
)
ORACLE["kb_stats"] = f"""{with_(KB_CTE)}
SELECT count(*) AS n_rows, count(DISTINCT city) AS n_cities, count(DISTINCT province) AS n_provinces FROM kb"""
ORACLE["value_counts"] = "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source"

DICTIONARY = """dictionary AS (
  SELECT 'name' AS kind, name AS value, min(dataid) AS ord FROM kb WHERE name IS NOT NULL GROUP BY name
  UNION ALL SELECT 'city', city, min(dataid) FROM kb WHERE city IS NOT NULL GROUP BY city
  UNION ALL SELECT 'province', province, min(dataid) FROM kb WHERE province IS NOT NULL GROUP BY province)"""
ORACLE["entity_dictionary"] = f"{with_(KB_CTE, DICTIONARY)} SELECT kind, value, ord FROM dictionary"
ORACLE["equality_filter"] = "SELECT doc_id, source FROM documents WHERE lang = 'de'"

FIRST_ROWS = "firsts AS (SELECT name, min(dataid) AS dataid FROM kb GROUP BY name)"
ORACLE["exact_lookup"] = f"""{with_(KB_CTE, REQUESTS_CTE, FIRST_ROWS)}
SELECT qid, wanted, coalesce(dataid, 0) AS dataid FROM requests LEFT JOIN firsts ON wanted = name"""
ORACLE["fuzzy_lookup"] = f"""{with_(KB_CTE, REQUESTS_CTE, FIRST_ROWS)},
partial AS (SELECT wanted, min(dataid) AS dataid FROM (SELECT DISTINCT wanted FROM requests), kb
            WHERE contains(wanted, name) OR contains(name, wanted) GROUP BY wanted)
SELECT qid, r.wanted AS wanted, coalesce(firsts.dataid, partial.dataid, 0) AS dataid,
       CASE WHEN firsts.dataid IS NOT NULL THEN 'exact' WHEN partial.dataid IS NOT NULL THEN 'contains' END AS how
FROM requests r LEFT JOIN firsts ON r.wanted = name LEFT JOIN partial ON r.wanted = partial.wanted"""
ORACLE["fuzzy_lookup_oneway"] = f"""{with_(KB_CTE, REQUESTS_CTE)},
partial AS (SELECT wanted, min(dataid) AS dataid FROM (SELECT DISTINCT wanted FROM requests), kb
            WHERE contains(name, wanted) GROUP BY wanted)
SELECT qid, r.wanted AS wanted, coalesce(dataid, 0) AS dataid FROM requests r LEFT JOIN partial ON r.wanted = partial.wanted"""

# --- rule answers --------------------------------------------------------------

KEYWORDS_CTE = values(
    "keywords", "intent, pos, n, keyword",
    [(i, p, len(ws), w) for p, (i, ws) in enumerate(C.INTENT_KEYWORDS.items()) for w in ws],
)
INTENTS = f"""{KEYWORDS_CTE},
counted AS (SELECT qid, intent, pos, n, count(*) AS hits FROM questions, keywords
            WHERE contains(text, keyword) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, pos) AS place FROM counted),
intents AS (
  SELECT q.qid, CASE WHEN hits / n >= {C.MIN_INTENT_CONFIDENCE} THEN intent ELSE 'UNKNOWN' END AS intent,
         CASE WHEN hits / n >= {C.MIN_INTENT_CONFIDENCE} THEN least(hits / n, 1.0) ELSE 0.0 END AS confidence
  FROM questions q LEFT JOIN ranked l ON q.qid = l.qid AND place = 1)"""
ORACLE["keyword_intent"] = (
    f"{with_(QUESTIONS_CTE, INTENTS)} SELECT qid, intent, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM intents"
)
ORACLE["intent_description"] = f"""
{with_(QUESTIONS_CTE, INTENTS, values('descriptions', 'name, description', C.INTENT_DESCRIPTIONS.items()))}
SELECT qid, coalesce(description, {lit(C.UNKNOWN_DESCRIPTION)}) AS description
FROM intents LEFT JOIN descriptions ON intent = name"""

ENTITIES = f"""{DICTIONARY},
found AS (SELECT qid, kind, value, ord FROM questions, dictionary WHERE value <> '' AND contains(text, value)),
entities AS (
  SELECT q.qid, any_value(text) AS text,
         coalesce(string_agg(value, '|' ORDER BY ord) FILTER (WHERE kind = 'name'), '') AS names,
         coalesce(string_agg(value, '|' ORDER BY ord) FILTER (WHERE kind = 'city'), '') AS cities,
         coalesce(string_agg(value, '|' ORDER BY ord) FILTER (WHERE kind = 'province'), '') AS provinces,
         min(ord) FILTER (WHERE kind = 'name') AS row_id,
         arg_min(value, ord) FILTER (WHERE kind = 'city') AS first_city,
         arg_min(value, ord) FILTER (WHERE kind = 'name') AS first_name
  FROM questions q LEFT JOIN found f ON q.qid = f.qid GROUP BY q.qid)"""
ORACLE["entity_match"] = (
    f"{with_(KB_CTE, QUESTIONS_CTE, ENTITIES)} SELECT qid, names, cities, provinces FROM entities"
)
ORACLE["entity_match_two_kinds"] = f"{with_(KB_CTE, QUESTIONS_CTE, ENTITIES)} SELECT qid, names, cities FROM entities"
ORACLE["passage_match"] = (
    "SELECT doc_id, item_id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text)"
)
ORACLE["entity_match_blocked"] = ORACLE["passage_match"]


def slot(field: str) -> str:
    source = f"CAST({field} AS VARCHAR)" if field == "rating" else field
    return f"coalesce(nullif({source}, ''), {lit(C.MISSING)})"


SLOTS = "slots AS (SELECT dataid, " + ", ".join(f"{slot(f)} AS {f}" for f in C.DOCUMENT_LABELS) + " FROM kb)"
RECOMMENDED = f"""{TOP_RATED},
recommended AS (
  SELECT city, {lit(C.CITY_HEADER.split('{city}')[0])} || city || {lit(C.CITY_HEADER.split('{city}')[1])} || string_agg(
           {template(C.CITY_LINE, {'rank': 'CAST(rank AS VARCHAR)', 'name': slot('name'), 'rating': slot('rating')})},
           chr(10) ORDER BY rank) AS recommendation
  FROM top_rated GROUP BY city)"""
ORACLE["city_recommend"] = f"{with_(KB_CTE, RECOMMENDED)} SELECT city, recommendation FROM recommended"


def rendered(templates: dict[str, str], default: str) -> str:
    columns = {f: f"s.{f}" for f in C.DOCUMENT_LABELS}
    cases = " ".join(f"WHEN {lit(i)} THEN {template(t, columns)}" for i, t in templates.items())
    return f"CASE intent {cases} ELSE {template(default, columns)} END"


def rules(questions: str) -> str:
    return f"""{with_(KB_CTE, questions, INTENTS, ENTITIES, SLOTS, RECOMMENDED)},
answered AS (
  SELECT e.qid, i.intent, round(CAST(i.confidence AS DOUBLE), 6) AS confidence, e.names, e.cities, e.provinces,
         CASE WHEN row_id IS NOT NULL THEN {rendered(C.RULE_TEMPLATES, C.RULE_DEFAULT_TEMPLATE)}
              WHEN first_city IS NOT NULL THEN recommendation ELSE {lit(C.RULE_HELP)} END AS answer,
         CASE WHEN row_id IS NOT NULL THEN s.name WHEN first_city IS NOT NULL THEN {lit(C.CITY_MATCH_LABEL)} END AS matched,
         row_id
  FROM entities e JOIN intents i ON e.qid = i.qid LEFT JOIN slots s ON row_id = s.dataid
  LEFT JOIN recommended r ON first_city = r.city)"""


RULE_COLUMNS = "qid, intent, confidence, names, cities, provinces, answer, matched"
ORACLE["rule_qa"] = f"{rules(QUESTIONS_CTE)} SELECT {RULE_COLUMNS} FROM answered"
ORACLE["stream_rule_qa"] = f"{rules(f'questions AS ({TURNS})')} SELECT {RULE_COLUMNS} FROM answered"

SLOT_ROWS = values(
    "slot_fields", "intent_name, field", [(i, f) for i, fields in C.INTENT_SLOTS.items() for f in fields]
)
SLOT_VALUE = "CASE field " + " ".join(f"WHEN '{f}' THEN s.{f}" for f in C.DOCUMENT_LABELS) + " END"
ORACLE["slot_fill"] = f"""{rules(QUESTIONS_CTE)}, {SLOT_ROWS}
SELECT qid, intent, field, {SLOT_VALUE} AS value
FROM answered JOIN slot_fields ON intent = intent_name JOIN slots s ON row_id = s.dataid"""
STYLES = " UNION ALL ".join(
    f"SELECT qid, intent, {lit(style)} AS style, CASE WHEN s.dataid IS NOT NULL THEN {rendered(templates, default)} END AS answer "
    "FROM requests LEFT JOIN slots s ON row_id = s.dataid"
    for style, templates, default in (
        ("rules", C.RULE_TEMPLATES, C.RULE_DEFAULT_TEMPLATE),
        ("classifier", C.CLASSIFIER_TEMPLATES, C.CLASSIFIER_DEFAULT_TEMPLATE),
    )
)
ORACLE["render_answer"] = f"""{with_(KB_CTE, QUESTIONS_CTE, INTENTS, SLOTS, FIRST_ROWS)},
requests AS (
  SELECT i.qid AS qid, intent, f.dataid AS row_id
  FROM intents i JOIN questions q ON i.qid = q.qid LEFT JOIN firsts f ON split_part(q.text, '的', 1) = f.name)
{STYLES}"""

# --- terms and retrieval --------------------------------------------------------


def char_counts(source: str, key: str, text: str, prefix: str) -> str:
    """CTE ``{prefix}_tf``: (key, term, tf) of space-padded words, word by word."""
    return f"""{prefix}_words AS (
  SELECT {key} AS k, ' ' || w || ' ' AS w
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), {WS})) AS w FROM {source}) WHERE w <> ''),
{prefix}_chars AS (SELECT k, regexp_extract_all(w, '(?s).') AS cs FROM {prefix}_words),
{prefix}_tf AS (
  SELECT k, term, count(*) AS tf FROM (
    SELECT k, unnest(cs) AS term FROM {prefix}_chars
    UNION ALL
    SELECT k, unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) FROM {prefix}_chars)
  GROUP BY k, term)"""


FEATURES = RetrievalConfig().max_features


def indexed(source: str, key: str, text: str) -> str:
    return f"""{char_counts(source, key, text, 'd')},
terms AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
         ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf
  FROM d_tf GROUP BY term),
vocabulary AS (SELECT * FROM terms ORDER BY cf DESC, term LIMIT {FEATURES}),
d_raw AS (SELECT k, d_tf.term AS term, tf * idf AS w FROM d_tf JOIN vocabulary USING (term)),
d_norm AS (SELECT k, sqrt(sum(w * w)) AS norm FROM d_raw GROUP BY k),
d_vec AS (SELECT d_raw.k AS k, term, w / norm AS w FROM d_raw JOIN d_norm ON d_raw.k = d_norm.k)"""


def cosines(source: str, key: str, text: str) -> str:
    return f"""{char_counts(source, key, text, 'q')},
q_raw AS (SELECT k, q_tf.term AS term, tf * idf AS w FROM q_tf JOIN vocabulary USING (term)),
q_norm AS (SELECT k, sqrt(sum(w * w)) AS norm FROM q_raw GROUP BY k),
q_vec AS (SELECT q_raw.k AS k, term, w / norm AS w FROM q_raw JOIN q_norm ON q_raw.k = q_norm.k),
cosines AS (SELECT q.k AS qid, d.k AS doc_id, sum(q.w * d.w) AS cosine
            FROM q_vec q JOIN d_vec d ON q.term = d.term GROUP BY ALL)"""


ORACLE["char_terms"] = (
    f"WITH {char_counts('documents', 'doc_id', 'text', 'd')} SELECT k AS doc_id, term, tf FROM d_tf"
)
ORACLE["term_idf"] = (
    f"WITH {indexed('documents', 'doc_id', 'text')} SELECT term, df, cf, round(idf, 6) AS idf FROM terms"
)
ORACLE["index_postings"] = (
    f"WITH {indexed('documents', 'doc_id', 'text')} SELECT k AS doc_id, term, round(w, 6) AS weight FROM d_vec"
)
SEARCHED = f"WITH {indexed('documents', 'doc_id', 'text')}, {cosines('benchmark', 'item_id', 'text')}"
MIN_SCORE = RetrievalConfig().min_score
ORACLE["cosine_scores"] = f"""{SEARCHED}
SELECT item_id, (SELECT count(*) FROM documents) AS n_docs, round(coalesce(sum(round(cosine, 9)), 0), 4) AS sum_score,
       round(coalesce(max(cosine), 0), 6) AS max_score
FROM benchmark LEFT JOIN cosines ON item_id = qid GROUP BY item_id"""
ORACLE["retrieve_topk"] = f"""{SEARCHED}
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (
  SELECT qid AS item_id, doc_id, round(cosine, 9) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, doc_id) AS rank FROM cosines)
WHERE rank <= 3 AND score >= {MIN_SCORE}"""

ORACLE["retrieve_topk_tiled"] = ORACLE["index_roundtrip"] = ORACLE["retrieve_topk"]

CONTENT = " || chr(10) || ".join(f"{lit('【' + label + '】')} || {slot(f)}" for f, label in C.DOCUMENT_LABELS.items())
DOCS = f"docs AS (SELECT dataid AS doc_id, name, city, {CONTENT} AS content FROM kb)"
ORACLE["row_documents"] = f"{with_(KB_CTE, DOCS)} SELECT doc_id, name, city, content FROM docs"

BOOSTS = f"""{ENTITIES},
known AS (SELECT qid, string_split(names, '|') AS names, string_split(cities, '|') AS cities,
                 string_split(provinces, '|') AS provinces, names || cities || provinces <> '' AS any_entity FROM entities),
lists AS (SELECT qid, list_filter(names, lambda x: x <> '') AS names, list_filter(cities, lambda x: x <> '') AS cities,
                 list_filter(provinces, lambda x: x <> '') AS provinces FROM known),
boosts AS (
  SELECT qid, doc_id,
         CASE WHEN list_contains(cities, city) THEN {C.BOOST_CITY} ELSE 0 END
         + CASE WHEN len(list_filter(provinces, lambda p: contains(content, p))) > 0 THEN {C.BOOST_PROVINCE} ELSE 0 END
         + CASE WHEN list_contains(names, name) THEN {C.BOOST_NAME}
                WHEN len(list_filter(names, lambda n: contains(n, name) OR contains(name, n))) > 0
                THEN {C.BOOST_NAME_PART} ELSE 0 END AS boost
  FROM lists, docs)"""
BOOSTED = with_(KB_CTE, QUESTIONS_CTE, DOCS, BOOSTS)
ORACLE["entity_boost"] = f"""{with_(KB_CTE, QUESTIONS_CTE, DOCS, ENTITIES)},
recognised AS (SELECT DISTINCT kind, value FROM found)
SELECT kind, value, doc_id, {C.BOOST_CITY} AS weight FROM recognised, docs WHERE kind = 'city' AND value = city
UNION ALL
SELECT kind, value, doc_id, {C.BOOST_PROVINCE} FROM recognised, docs WHERE kind = 'province' AND contains(content, value)
UNION ALL
SELECT kind, value, doc_id, CASE WHEN value = name THEN {C.BOOST_NAME} ELSE {C.BOOST_NAME_PART} END FROM recognised, docs
WHERE kind = 'name' AND (contains(value, name) OR contains(name, value))"""
ORACLE["entity_boost"] = f"SELECT kind, value, doc_id, CAST(weight AS DOUBLE) AS weight FROM ({ORACLE['entity_boost']})"
ORACLE["question_boost"] = (
    f"{BOOSTED} SELECT qid, round(CAST(max(boost) AS DOUBLE), 6) AS max_boost FROM boosts GROUP BY qid"
)

HITS = f"""{BOOSTED}, {indexed('docs', 'doc_id', 'content')}, {cosines('questions', 'qid', 'text')},
fused AS (
  SELECT b.qid AS qid, b.doc_id AS doc_id, coalesce(cosine, 0) AS cosine, CAST(boost AS DOUBLE) AS boost,
         CASE WHEN max(boost) OVER (PARTITION BY b.qid) > 0
              THEN {C.FUSE_COSINE} * coalesce(cosine, 0) + {C.FUSE_BOOST} * CAST(boost AS DOUBLE)
              ELSE coalesce(cosine, 0) END AS score
  FROM boosts b LEFT JOIN cosines c ON b.qid = c.qid AND b.doc_id = c.doc_id),
hits AS (
  SELECT f.qid AS qid, CAST(rank AS INTEGER) AS rank, f.doc_id AS doc_id, name, city, content, score, cosine, boost
  FROM (SELECT qid, doc_id, round(score, 9) AS score, cosine, boost,
               row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM fused) f
  JOIN docs d ON f.doc_id = d.doc_id WHERE rank <= 3 AND score >= {MIN_SCORE})"""
ORACLE["hybrid_topk"] = f"{HITS} SELECT qid, rank, doc_id, round(score, 6) AS score FROM hits"
ORACLE["hybrid_topk_tiled"] = ORACLE["hybrid_topk_stored"] = ORACLE["hybrid_topk"]
ORACLE["score_breakdown"] = f"""{HITS}
SELECT qid, rank, name, city, round(score, 6) AS score, round(cosine, 6) AS tfidf_score, round(boost, 6) AS entity_boost
FROM hits"""
ORACLE["hit_preview"] = f"""{HITS}
SELECT qid, rank, name, round(round(score, 6) * 100, 1) AS percent, {cut('content', 500)} AS preview FROM hits"""

PROMPT = template(C.USER_PROMPT, {"documents": "blocks", "question": "q.text"})
BLOCK = template(C.PROMPT_DOCUMENT, {"rank": "CAST(rank AS VARCHAR)", "name": "name", "content": "content"})
PROMPTS = f"""prompts AS (
  SELECT q.qid AS qid, {PROMPT} AS prompt
  FROM questions q JOIN (SELECT qid, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY rank) AS blocks
                         FROM hits GROUP BY qid) l ON q.qid = l.qid)"""
ORACLE["prompt_table"] = (
    f"{HITS}, {PROMPTS} SELECT qid, {lit(C.SYSTEM_PROMPT)} AS system_prompt, prompt FROM prompts"
)

LABEL_RULES = values(
    "label_rules", "place, keyword, label", [(i, k, v) for i, (k, v) in enumerate(C.ANSWER_LABEL_RULES.items())]
)
FIELD_LABELS = values(
    "field_labels", "field, field_label", C.DOCUMENT_LABELS.items()
)
TEMPLATES = f"""{LABEL_RULES},
wanted AS (SELECT qid, arg_min(label, place) AS label FROM questions, label_rules
           WHERE contains(text, keyword) GROUP BY qid),
firsts AS (SELECT h.qid AS qid, name, content, label, string_split(content, chr(10)) AS lines
           FROM hits h LEFT JOIN wanted w ON h.qid = w.qid WHERE rank = 1),
picked AS (
  SELECT *, list_filter(lines, lambda l: contains(l, label))[1] AS line,
         list_filter(list_transform(list_filter(lines, lambda l: contains(l, {lit(C.SUMMARY_LABEL)})),
                                    lambda l: trim(string_split(l, '】')[-1])),
                     lambda v: v <> '' AND v <> {lit(C.MISSING)})[1] AS summary
  FROM firsts),
templates AS (
  SELECT qid, CASE
    WHEN line IS NOT NULL AND trim(string_split(line, '】')[-1]) NOT IN ('', {lit(C.MISSING)})
      THEN {template(C.FIELD_ANSWER, {'name': 'name', 'label': 'label', 'value': "trim(string_split(line, '】')[-1])"})}
    WHEN line IS NOT NULL THEN {template(C.FIELD_ANSWER_MISSING, {'name': 'name', 'label': 'label'})}
    WHEN summary IS NOT NULL THEN {template(C.SUMMARY_ANSWER, {'name': 'name', 'value': '(' + cut('summary', C.SUMMARY_LENGTH) + ')'})}
    ELSE {template(C.GENERIC_ANSWER, {'name': 'name'})} END AS template
  FROM picked)"""
ORACLE["template_answer"] = f"{HITS}, {TEMPLATES} SELECT qid, template FROM templates"
ORACLE["answer_fallback"] = f"""{HITS}, {TEMPLATES}
SELECT qid, CASE WHEN qid % 4 = 0 THEN '回答' || CAST(qid AS VARCHAR) ELSE template END AS answer,
       qid % 4 = 0 AS use_llm FROM templates"""
ORACLE["batch_generate"] = f"""{HITS}, {PROMPTS}
SELECT qid, '收到' || CAST(length(prompt) AS VARCHAR) || '字' AS generated, 'ok' AS status FROM prompts"""
ORACLE["batch_generate_durable"] = f"""{HITS}, {PROMPTS}
SELECT qid, CASE WHEN length(prompt) % 5 = 0 THEN '再收到' ELSE '收到' END || CAST(length(prompt) AS VARCHAR) || '字' AS generated,
       'ok' AS status FROM prompts"""
ORACLE["rag_qa"] = f"""{HITS}, {PROMPTS}, {TEMPLATES}, {INTENTS},
listed AS (SELECT qid, count(*) AS n_docs, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY rank) AS doc_ids,
                  arg_min(name, rank) AS best FROM hits GROUP BY qid)
SELECT e.qid AS qid, e.text AS question, coalesce(n_docs, 0) AS n_docs, coalesce(doc_ids, '') AS doc_ids,
       coalesce(length(prompt), 0) AS prompt_length, coalesce(template, {lit(C.NO_HIT_ANSWER)}) AS answer,
       false AS use_llm, intent, round(CAST(confidence AS DOUBLE), 6) AS confidence, e.names AS names,
       coalesce(best, first_name) AS matched
FROM entities e JOIN intents i ON e.qid = i.qid LEFT JOIN listed l ON e.qid = l.qid
LEFT JOIN prompts p ON e.qid = p.qid LEFT JOIN templates t ON e.qid = t.qid"""

# --- classification -------------------------------------------------------------


def tokens(source: str, key: str, text: str) -> str:
    """CTE ``tokens``: (k, ts), the words of each text in order."""
    return f"""runs AS (SELECT {key} AS k, regexp_extract_all(lower({text}), {lit(TOKEN)}, 1) AS rs FROM {source}),
tokens AS (
  SELECT k, flatten(list_transform(rs, lambda r: CASE WHEN regexp_matches(r, {lit(f'^[{CHINESE}]')})
    THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END)) AS ts FROM runs)"""


SINGLE = "SELECT k, unnest(ts) AS term FROM tokens"
PAIRS = "SELECT k, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS term FROM tokens"
DOC_TOKENS = tokens("documents", "doc_id", "text")
ORACLE["word_terms"] = f"WITH {DOC_TOKENS} SELECT k AS doc_id, term, count(*) AS tf FROM ({SINGLE}) GROUP BY ALL"
ORACLE["word_bigrams"] = f"WITH {DOC_TOKENS} SELECT k AS doc_id, term, count(*) AS tf FROM ({PAIRS}) GROUP BY ALL"
ORACLE["question_terms"] = f"""{with_(QUESTIONS_CTE)}, {tokens('questions', 'qid', 'text')}
SELECT k AS qid, term, count(*) AS tf FROM ({SINGLE} UNION ALL {PAIRS}) GROUP BY ALL"""
CONFIG = ClassifierConfig()
VOCABULARY = f"""WITH {DOC_TOKENS},
tf AS (SELECT k, term, count(*) AS tf FROM ({SINGLE} UNION ALL {PAIRS}) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
                 ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
vocabulary AS (SELECT * FROM terms WHERE df <= {CONFIG.max_df} * (SELECT count(*) FROM documents)
               ORDER BY cf DESC, term LIMIT {CONFIG.max_features})"""
ORACLE["vocab_prune"] = f"{VOCABULARY} SELECT term, df, cf FROM vocabulary"
ORACLE["tfidf_sublinear"] = f"""{VOCABULARY},
raw AS (SELECT k, tf.term AS term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocabulary USING (term)),
norms AS (SELECT k, sqrt(sum(w * w)) AS norm FROM raw GROUP BY k)
SELECT raw.k AS doc_id, term, round(w / norm, 6) AS weight FROM raw JOIN norms ON raw.k = norms.k"""

LABELLED = """labelled AS (
  SELECT d.doc_id AS doc_id, CAST(quality AS VARCHAR) || '-' || CAST(toxic AS VARCHAR) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
ORACLE["label_rows"] = f"WITH {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label"
ORACLE["class_weights"] = f"""WITH {LABELLED}
SELECT label, count(*) AS n,
       round((SELECT count(*) FROM labelled) / ((SELECT count(DISTINCT label) FROM labelled) * count(*)), 6) AS weight
FROM labelled GROUP BY label"""
ORACLE["stratified_split"] = f"""
SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
       <= floor(count(*) OVER (PARTITION BY lang) * {CONFIG.train_fraction} + 1e-9) AS is_train FROM documents"""
GUESSED = """guessed AS (
  SELECT lang AS label, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' und ') THEN 'de'
    WHEN contains(text, ' le ') THEN 'fr' WHEN contains(text, ' el ') THEN 'es' ELSE 'xx' END AS predicted FROM documents)"""
ORACLE["confusion_matrix"] = f"WITH {GUESSED} SELECT label, predicted, count(*) AS n FROM guessed GROUP BY ALL"
ORACLE["classification_report"] = f"""WITH {GUESSED},
names AS (SELECT label FROM guessed UNION SELECT predicted FROM guessed),
counts AS (SELECT n.label AS label, (SELECT count(*) FROM guessed g WHERE g.label = n.label) AS support,
                  (SELECT count(*) FROM guessed g WHERE g.predicted = n.label) AS said,
                  (SELECT count(*) FROM guessed g WHERE g.label = n.label AND g.predicted = n.label) AS hits FROM names n),
ratios AS (SELECT label, support, CASE WHEN said > 0 THEN hits / said ELSE 0.0 END AS p,
                  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM counts)
SELECT label, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support,
       (SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) FROM guessed) AS accuracy
FROM ratios"""
ORACLE["softmax_confidence"] = """
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS best,
       round(exp(list_max(s)) / list_sum(list_transform(s, lambda x: exp(x))), 6) AS confidence
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings)"""

ORACLE["svm_predict"] = """
SELECT lang AS label, count(*) AS n, true AS good FROM documents GROUP BY lang
UNION ALL SELECT 'turns', count(*), true FROM conversations"""
ORACLE["svm_save_load"] = "SELECT count(*) AS n_turns, 0 AS n_different FROM conversations"
TWO_KINDS = f"""{with_(KB_CTE, QUESTIONS_CTE, ENTITIES, SLOTS, RECOMMENDED)},
matches AS (
  SELECT qid, names, cities, row_id, recommendation,
         CASE WHEN row_id IS NOT NULL THEN first_name WHEN first_city IS NOT NULL THEN {lit(C.CITY_MATCH_LABEL)} END AS matched
  FROM entities LEFT JOIN recommended ON first_city = city)"""
ORACLE["classification_qa"] = f"""{TWO_KINDS}
SELECT qid, names, cities, matched, CASE WHEN row_id IS NOT NULL THEN true END AS as_predicted,
       CASE WHEN row_id IS NULL THEN coalesce(recommendation, {lit(C.CLASSIFIER_HELP)}) END AS other_answer, true AS sound
FROM matches"""
ORACLE["compare_methods"] = f"""
SELECT q.qid AS qid, q.question AS text, r.intent AS rules_intent, r.matched AS rules_matched, r.answer AS rules_answer,
       q.intent AS retrieval_intent, q.matched AS retrieval_matched, q.answer AS retrieval_answer,
       m.matched AS classification_matched, true AS classification_intent_known,
       CASE WHEN m.row_id IS NOT NULL THEN true END AS classification_as_predicted,
       CASE WHEN m.row_id IS NULL THEN coalesce(m.recommendation, {lit(C.CLASSIFIER_HELP)}) END AS classification_other_answer
FROM ({ORACLE['rag_qa']}) q JOIN ({ORACLE['rule_qa']}) r ON q.qid = r.qid
JOIN ({TWO_KINDS} SELECT qid, matched, row_id, recommendation FROM matches) m ON q.qid = m.qid"""
ORACLE["intent_examples"] = f"""{with_(QUESTIONS_CTE, INTENTS, values('examples', 'name, n', [(k, len(v)) for k, v in TRAINING_TEXTS.items()]))}
SELECT intent, count(*) AS n_questions, coalesce(any_value(n), 0) AS n_examples
FROM intents LEFT JOIN examples ON intent = name GROUP BY intent"""

# --- files ------------------------------------------------------------------------

NULLS = ", ".join(lit(v) for v in C.CSV_NULLS)
READ_BACK = ", ".join(
    f"CASE WHEN replace({c}, '¥', '￥') NOT IN ({NULLS}) THEN replace({c}, '¥', '￥') END AS {short}"
    for short, c in zip(RAW_SHORT, RAW_RENAMES)
)
ORACLE["ingest_encodings"] = (
    f"{with_(RAW_CTE, PROVINCES_CTE)} SELECT ord, CASE WHEN city IN (SELECT city FROM provinces) THEN city "
    f"ELSE {lit(OTHER_CITY)} END AS city, {READ_BACK} FROM raw_rows"
)
KB_TEXTS = ["address", "phone", "website", "ticket_price", "open_time", "suggest_time", "tags", "description", "tips"]
ORACLE["kb_csv_roundtrip"] = (
    f"{with_(KB_CTE)} SELECT dataid, name, city, province, rating, "
    + ", ".join(f"nullif({c}, '') AS {c}" for c in KB_TEXTS)
    + " FROM kb"
)
