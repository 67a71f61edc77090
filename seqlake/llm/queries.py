"""The operators of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import (
    common, decontamination, divergence, hamming_search, html_extraction, language_id, packing, quality_gam, ranked_search,
    secret_scan, simhash_dedup, substring_dedup, suffix_dedup, toxicity,
)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(common.read(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS content
  FROM texts, unnest(range(1, len(ws) - 48)) t(i)),
found AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS low FROM windows),
covered AS (SELECT DISTINCT doc_id, i + j AS i FROM found, range(50) r(j) WHERE low < doc_id),
placed AS (SELECT doc_id, i, ws[i] AS word FROM texts, unnest(range(1, len(ws) + 1)) t(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.main_text(common.read(spark, folder, "pages"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan.scan(common.read(spark, folder, "documents"))
    base = [number for number, rule in enumerate(secret_scan.RULES) if rule.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    digest = secret_scan.spans_text(F.filter("found", lambda s: s["kind"].isin(base)))
    return rows.select(
        "doc_id",
        *[count(number).alias(f"n_{secret_scan.RULES[number].kind}") for number in base],
        F.sha2(digest, 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
    )


def _op4_sql() -> str:
    """Each rule's matches with their places, from the pieces between them; of a key also what belongs to it."""
    quoted = lambda pattern: pattern.replace("'", "''")
    places = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)"
    parts = []
    for number, rule in enumerate(secret_scan.RULES):
        pattern = quoted(rule.pattern)
        size, ok = "length(found[i])", f"length(tested[i]) >= {rule.least}"
        if rule.key:
            size, ok = "length(found[i]) + key_length", "key_length > 0"
        texts = f"""(
  SELECT *, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found,
         regexp_extract_all(text, '{pattern}', {rule.group}) AS tested FROM texts), unnest(range(1, len(found) + 1)) t(i)"""
        if rule.key:
            texts = f"""(
  SELECT *, CASE WHEN ended > 0 THEN ended WHEN last IS NULL THEN 0
         ELSE coalesce(list_sum(list_transform(lines[1:last - 1], lambda x: length(x))), 0)
              + length(regexp_replace(lines[last], '{secret_scan.KEY_LINE_END}', '')) END AS key_length
  FROM (
    SELECT *, CASE WHEN known[long + 1] = 1 AND known[long + 2] = 3 THEN long + 2 WHEN known[long + 1] IN (1, 3) THEN long + 1 ELSE long END AS last
    FROM (
      SELECT *, list_max(list_filter(range(1, len(known) + 1), lambda x: known[x] = 2)) AS long
      FROM (
        SELECT *, CASE WHEN list_position(kinds, -1) > 0 THEN kinds[1:list_position(kinds, -1) - 1] ELSE kinds END AS known
        FROM (
          SELECT *, list_transform(lines, lambda x: CASE
                   WHEN regexp_matches(x, '{secret_scan.KEY_BLANK}') OR regexp_matches(x, '{secret_scan.KEY_HEADER}') THEN 0
                   WHEN regexp_matches(x, '{secret_scan.KEY_BASE64}') AND NOT regexp_matches(x, '{secret_scan.KEY_PROSE}') THEN 2
                   WHEN regexp_matches(x, '{secret_scan.KEY_SHORT}') THEN 1 WHEN regexp_matches(x, '{secret_scan.KEY_SUM}') THEN 3 ELSE -1 END) AS kinds,
                 length(regexp_extract(rest, '{secret_scan.KEY_END}', 0)) AS ended
          FROM (SELECT *, gaps[i + 1] AS rest, regexp_extract_all(gaps[i + 1], '{secret_scan.KEY_LINE}', 0) AS lines FROM {texts}))))))"""
        parts.append(f"""
  SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, i, {places} AS start, {size} AS size, {ok} AS ok FROM {texts}""")
    spans = "concat(name, ':', CAST(start AS BIGINT), ':', CAST(start + size AS BIGINT))"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
digests AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg({spans}, ',' ORDER BY start, kind) FILTER (kind <= 2) AS base, string_agg({spans}, ',' ORDER BY start, kind) AS spans
  FROM hits WHERE ok GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN digests d ON d.doc_id = t.doc_id
"""


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(common.read(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.repeats(common.read(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_repeated", "n_removed")


OP6_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS content
  FROM texts, unnest(range(1, len(ws) - 48)) t(i)),
found AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS low, max(doc_id) OVER (PARTITION BY content) AS high
  FROM windows),
covered AS (
  SELECT doc_id, i + j AS i, bool_or(low < doc_id) AS later FROM found, range(50) r(j) WHERE low < high GROUP BY ALL)
SELECT doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, count(*) AS n_repeated, count(*) FILTER (later) AS n_removed
FROM covered JOIN texts USING (doc_id) GROUP BY doc_id
"""


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, common.read(spark, folder, "labels")))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find(
        common.read(spark, folder, "documents"), spark.read.parquet(f"{folder}/benchmark.parquet")
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(common.read(spark, folder, "documents"))


def op10_hamming_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    codes = common.stored(hamming_search.sign_codes(common.read(spark, folder, "embeddings"), "vec_id", "embedding"), "codes")
    return hamming_search.top_k(codes, codes.filter("id % 50 = 0"))


OP10_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: CAST((x[1] > 0) <> (x[2] > 0) AS INTEGER))) AS INTEGER) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance
FROM pairs QUALIFY rank <= 10
"""


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(common.read(spark, folder, "documents"))


# A-Z alone change case; the figures are wider than 64 bits on their way.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, {_LOWERED} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(total), 0) AS held
  FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS own FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + (1000000000 :: HUGEINT * (coalesce(n, 0) + 1)) // (own + v) AS p, 1 + (1000000000 :: HUGEINT * (total + 1)) // (held + v) AS q
  FROM sizes JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.top_documents(
        common.read(spark, folder, "documents"), spark.read.parquet(f"{folder}/benchmark.parquet")
    )


OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms)) :: BIGINT AS n_terms FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT id, unnest(terms) AS term FROM docs),
counts AS (SELECT id, term, count(*) AS tf FROM held SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2.0 :: DOUBLE * n_docs + 2) / (2 * count(*) + 1))) :: BIGINT AS w
  FROM counts, totals GROUP BY term, n_docs),
impacts AS (
  SELECT id, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * n_docs) // n_terms)) AS impact
  FROM counts JOIN docs USING (id), totals),
scores AS (
  SELECT item_id, id, doc_id, sum(w * impact) :: BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING sum(w * impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50
"""


def op13_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, common.read(spark, folder, "labels")))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_hamming_search": op10_hamming_search,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_quality_gam": op13_quality_gam,
}
ORACLES = {
    "op1_substring_dedup": OP1_SQL,
    "op4_secret_scan": _op4_sql(),
    "op6_suffix_dedup": OP6_SQL,
    "op10_hamming_search": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}
