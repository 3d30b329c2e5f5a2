"""The queries of the training-data operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.llm import decontaminate, langmodel, licenses, mixing, quality, secretscan, simhash, substrings, tokencount, warc

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("places")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, width=1, complete=3)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.assign(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "second_position").orderBy("position", "doc_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_license_scan, op2_simhash_dedup, op3_warc_salvage, op4_substring_dedup, op5_token_counts,
        op6_quality_rules, op7_source_mixing, op8_decontaminate, op9_lm_score, op10_secret_scan, pipeline,
    )}


def _sql_licenses() -> str:
    rules = [(m, label, licenses.mandatory(licenses.parse(m)), i < len(licenses.PHRASES)) for i, (m, label) in enumerate((*licenses.PHRASES, *licenses.TEMPLATES))]
    hit = lambda m: f"regexp_matches(line, '{licenses.template_regex(m)}')"
    pick = lambda some: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {hit(m)} THEN '{x}' END" for m, x, _, _ in some) + "], lambda x: x IS NOT NULL))), ',')"
    ways = []
    for phrase, _ in licenses.PHRASES:
        ws = phrase.split()
        ways.append("(" + " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(ws)) + ")")
    most = "greatest(" + ", ".join(f"CASE WHEN {hit(m)} THEN {n} ELSE 0 END" for m, _, n, _ in rules) + ")"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(len(w)), lambda i: {" OR ".join(ways)}) AS spots, ' ' || array_to_string(w, ' ') || ' ' AS line FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
  {pick([r for r in rules if r[3]])} AS base_labels, {pick(rules)} AS labels, ({most})::DOUBLE / (({most}) + 1) AS score
FROM p"""


_SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS d FROM p),
r AS (SELECT page_id, n, d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n >= 1000) END AS top FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM r"""

_SQL_REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
v AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
m AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM v) WHERE n > 1),
g AS (SELECT DISTINCT r, p + j AS i FROM m, (SELECT unnest(range(0, 35)) AS j)),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS line FROM x ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""

_SQL_MIX = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
r AS (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS k FROM s),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, CASE k % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE -0.5 END::DOUBLE AS tilt, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, skey) AS n FROM w),
f AS (SELECT *, min(CASE WHEN w * level <= cap THEN n END) OVER () AS first FROM l),
g AS (SELECT *, max(CASE WHEN n = first THEN level END) OVER () AS final FROM f),
t AS (SELECT skey, source_size, tilt, CASE WHEN n < first THEN cap ELSE w * final END AS target FROM g),
a AS (SELECT doc_id, size, source_size, target, tilt, floor(target + 0.5)::BIGINT AS wanted,
    coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t USING (skey)),
b AS (SELECT *, least(size, greatest(0, wanted - start)) AS one, least(size, greatest(0, wanted - start - source_size)) AS two FROM a)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN 2.0::DOUBLE * (start::DOUBLE / wanted) / ((1.0::DOUBLE - tilt) + sqrt((1.0::DOUBLE - tilt) * (1.0::DOUBLE - tilt) + 4.0::DOUBLE * tilt * (start::DOUBLE / wanted))) END AS position,
  CASE WHEN two > 0 THEN 2.0::DOUBLE * ((start + source_size)::DOUBLE / wanted) / ((1.0::DOUBLE - tilt) + sqrt((1.0::DOUBLE - tilt) * (1.0::DOUBLE - tilt) + 4.0::DOUBLE * tilt * ((start + source_size)::DOUBLE / wanted))) END AS second_position
FROM b"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _sql_licenses(), "op3_warc_salvage": _SQL_WARC, "op4_substring_dedup": _SQL_REPEATS, "op7_source_mixing": _SQL_MIX}
