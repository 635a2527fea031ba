"""The registered queries of the operators and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specflow.llm import (
    chat,
    decontaminate,
    divergence,
    line_dedup,
    lm,
    neighbours,
    packing,
    secrets,
    sharding,
    simhash,
    spelling,
    toxicity,
    url_filter,
)
from specflow.llm.common import crc_rest
from specflow.session import table

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_rest(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    model = toxicity.train(documents, labels)
    scored = toxicity.score(documents, model, keep=["doc_id"])
    rejected = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", rejected.alias("predicted"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_rest(F.col("doc_id"), 10) == 0
    scored = lm.score(documents, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, URL_RULES)
    return judged.select("page_id", *[f"judged.{c}" for c in ("host", "path", "rule", "verdict")])


OP6_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rests AS (
  SELECT page_id, row_number() OVER () AS row,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, row, {LOWER_SQL.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
fits AS (
  SELECT p.row, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.row ORDER BY length(r.host) DESC, length(r.path) DESC) AS place
  FROM parts p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.row = p.row AND f.place = 1
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s.kind != "novel")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(documents.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


WORDS_SQL = "regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {WORDS_SQL} AS words FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS words FROM benchmark),
cut AS (
  SELECT item, words, least(13, len(words)) AS m, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS i
  FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(words[i : i + m - 1], ' ') AS w FROM cut),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT row, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i FROM docs, lengths WHERE len(words) >= m),
hits AS (
  SELECT p.row, p.i, p.m, w.item
  FROM (SELECT row, i, m, array_to_string(words[i : i + m - 1], ' ') AS w FROM places) p
  JOIN windows w ON w.m = p.m AND w.w = p.w),
covered AS (
  SELECT row, count(DISTINCT place) AS n_hit
  FROM (SELECT DISTINCT row, unnest(generate_series(i, i + m - 1)) AS place FROM hits) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN covered c ON c.row = d.row LEFT JOIN named n ON n.row = d.row
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_shared_lines(documents, documents=10, least=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (
  SELECT *, {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1
  GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON s.key = k.key GROUP BY row
"""

def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


TERMS_SQL = "regexp_extract_all(" + LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS_SQL} AS terms
  FROM documents),
found AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY f.lang, f.source, f.term),
group_sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gs.n, 0) + 2 * s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (s.n + 2 * s.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN group_sizes gs ON gs.lang = g.lang AND gs.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
found_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_variants(documents, least=6, often=5, ratio=5, every=199)


# crc32 by its table, made from the reversed polynomial; letters outside ASCII are one byte each in
# short words, so that a byte-wise distance counts code points
OP12_SQL = f"""
WITH RECURSIVE crc(entries) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, run, count(*) AS n FROM runs GROUP BY ALL),
spelled AS (
  SELECT *, flatten(list_transform(string_split(id || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END)) AS bytes
  FROM counted WHERE length(run) >= 6),
hashed AS (
  SELECT s.run, s.n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), s.bytes),
    lambda c, b: xor(c >> 8, crc.entries[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM spelled s, crc),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (
  SELECT word, n, length(word) AS len,
         translate(word, (SELECT string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY c) FROM range(192, 256) r(c)),
                   (SELECT string_agg(chr(CAST(c AS INTEGER)), '' ORDER BY c) FROM range(33, 97) r(c))) AS spelling
  FROM words),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n
  FROM short a JOIN short b ON b.len BETWEEN a.len - 1 AND a.len + 1 AND a.word <> b.word AND levenshtein(a.spelling, b.spelling) = 1),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
  SELECT word, word AS at, form AS onward FROM forms
  UNION ALL
  SELECT w.word, f.word, f.form FROM walk w JOIN forms f ON f.word = w.onward)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON w.word = f.word AND w.onward IS NULL
"""

def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    read = chat.canonical(given.select("conv_id", "turn", record.alias("record")), "record")
    turns = read.select("conv_id", "turn", F.posexplode("turns").alias("place", "said"))
    turns = turns.select("conv_id", "turn", "place", "said.role", "said.text")
    return chat.digests(chat.formatted(turns), "conv_id", ["turn", "place", "role", "text"])


def escaped_sql(c: str) -> str:
    for first, rest in ((r"\[", r"INST\]|/INST\]"), ("<", r"\||s>|/s>")):
        c = rf"regexp_replace({c}, '({first})(\\*)({rest})', '\1\2\\\3', 'g')"
    return c


OP13_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, '<|turn|>' || {escaped_sql("role")} || '<|text|>' || {escaped_sql("text")} || '<|end|>' AS piece FROM given)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {
    q.__name__: q
    for q in (
        op1_toxicity, op2_lm_scoring, op3_sharding, op4_packing, op5_neighbours, op6_url_filter, op7_secrets, op8_decontamination,
        op9_simhash, op10_line_dedup, op11_source_divergence, op12_spelling_variants, op13_chat_formatting,
    )
}
SQL = {
    "op6_url_filter": OP6_SQL, "op8_decontamination": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_source_divergence": OP11_SQL,
    "op12_spelling_variants": OP12_SQL, "op13_chat_formatting": OP13_SQL,
}
