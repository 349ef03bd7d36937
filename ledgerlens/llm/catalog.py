"""The registered queries of this subpackage, each over its whole table, and check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import alignment, htmltext, licenses, linededup, mixing, packing, periodic, pii, quality, secretscan, simhash, tokencount, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.materialized_fingerprints(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return simhash.near_groups(prints).select("doc_id", text, "component_id")


LINE_DEDUP_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, hash(doc_id, text) AS row_id FROM documents),
lines AS (
  SELECT doc_id, text, u.pos AS pos, l[u.pos] AS line,
         translate(trim(l[u.pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM docs) s, unnest(range(1, len(l) + 1)) AS u(pos)
),
bad AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT lines.*, bad.k IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN bad USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", LINE_DEDUP_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    """A public tokenizer file's place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2048, 0)


@query("op9_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


TOP_K_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CAST(p[1] <> p[2] AS INTEGER)))::INTEGER AS distance
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM pairs
) WHERE rank <= 10
"""


@query("op2_exact_top_k", TOP_K_SQL)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.top_k(codes, codes.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id"), 10)


@query("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.Mix(repeat_limit=2.0))


def license_sql() -> str:
    """The same cuts, dictionary and rules in SQL; sentences and rules become value lists."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    words = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in licenses.dictionary().items())
    longest = " bsd-grant bsd-source bsd-binary bsd-endorse "
    listed = ", ".join(
        f"({quoted(spdx)}, {quoted(' ' + ' '.join(order) + ' ')}, {quoted(longest if spdx == 'BSD-2-Clause' else '#')})" for spdx, order in licenses.rules()
    )
    cut = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
    for pattern, new in licenses.JOINED:
        cut = f"regexp_replace({cut}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    cut = rf"regexp_replace(regexp_replace({cut}, '([.;:!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g')"
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words(sentence, name) AS (VALUES {words}),
rules(spdx, line, unless) AS (VALUES {listed}),
sentences AS (
  SELECT r, u.pos AS pos, l[u.pos] AS s FROM (SELECT r, string_split({cut}, chr(1)) AS l FROM docs), unnest(range(1, len(l) + 1)) AS u(pos)
),
whole AS (SELECT r, pos, s, w.name AS name FROM sentences LEFT JOIN words w ON w.sentence = {norm.format("s")}),
lines AS (
  SELECT r, pos, u.at AS at, l[u.at] AS s FROM (SELECT r, pos, string_split(s, chr(10)) AS l FROM whole WHERE name IS NULL AND contains(s, chr(10))),
  unnest(range(1, len(l) + 1)) AS u(at)
),
hit AS (
  SELECT r, pos, 0 AS at, name FROM whole WHERE name IS NOT NULL UNION ALL
  SELECT r, pos, at, w.name FROM lines JOIN words w ON w.sentence = {norm.format("s")}
),
best AS (
  SELECT r, any_value(doc_id) AS doc_id, coalesce(string_agg(name, ' ' ORDER BY pos, at), '') AS ids FROM docs LEFT JOIN hit USING (r) GROUP BY r
),
hits AS (
  SELECT r, string_agg(DISTINCT spdx, ',' ORDER BY spdx) AS licenses FROM best JOIN rules
  ON contains(' ' || ids || ' ', line) AND NOT contains(' ' || ids || ' ', unless) WHERE ids <> '' GROUP BY r
)
SELECT doc_id, CASE WHEN ids = '' THEN 0 ELSE len(string_split(ids, ' ')) END AS n_sentences, ids AS sentence_ids, coalesce(licenses, '') AS licenses
FROM best LEFT JOIN hits USING (r)
"""


@query("op5_license_scan", license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_pii_spans")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op8_html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), change=periodic.tail_repeated).drop("runs")


@query("op13_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(table(spark, sf_dir, "documents"))
