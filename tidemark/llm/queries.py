"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import golay_simhash, hash_forest, language_id, line_dedup, mixing, outliers, packing, periodic_runs, quality_gam, spelling, suffix_dedup, text_stats, toxicity, url_filter


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to 150 % of their words at weights 5, 2, 1, two epochs at most."""
    sized = mixing.sized(_read(spark, sf_dir, "documents"))
    mixed = mixing.mix(sized, mixing.cyclic_weights(sized), share=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model learns from the labelled languages of ``documents``."""
    return language_id.identify(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op3_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every one whose id is divisible by 20."""
    return hash_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of 50 words or more that another one holds too, and where."""
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents")).filter("repeated_words > 0")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    scored = quality_gam.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of all documents."""
    found = outliers.reject_outliers(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", *text_stats.RULE_COLUMNS, "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return url_filter.filter_urls(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    found = golay_simhash.near_duplicates(_read(spark, sf_dir, "documents"), words_per_shingle=4, max_errors=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    kept = line_dedup.drop_common_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    scored = toxicity.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def drop_a_letter(doc_id: str, run: str) -> str:
    """The run without the code point that the checksum of its document and itself points at, if 31 divides that."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 31 else run[:at] + run[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.group_variants(spelling.count_words(_read(spark, sf_dir, "documents"), drop_a_letter))


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one text of ten the words from a point on are those of the first p from there, over and over.

    ``h`` is the checksum of the decimal doc_id; texts without an id or words stay as they are.
    """
    n, a, p = F.size("words"), F.col("a"), F.col("p")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int"))).withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
    again = F.array_join(F.transform(places, lambda i: F.get("words", i)), " ")
    return rows.select("doc_id", F.when(a.isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, one text of ten made to repeat itself."""
    found = periodic_runs.find_runs(repeating(_read(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("top.less"), F.col("top.period")
    return rows.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(-top.less) * 1000 div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other, over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_source_mix, op2_language_id, op3_hash_forest, op4_repeated_passages, op5_quality_gam, op6_robust_outliers, op7_url_filter, op8_retrieval_packing, op9_golay_simhash, op10_line_dedup, op11_toxic_segments, op12_spelling_variants, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, sum(2.0::DOUBLE * source_size) OVER o - 2.0::DOUBLE * source_size AS clamped_before,
         sum(weight) OVER () - sum(weight) OVER o + weight AS free_weight, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM sources WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT max((total - clamped_before) / free_weight) AS level FROM ordered
  WHERE (total - clamped_before) / free_weight <= 2.0::DOUBLE * source_size / weight
), plan AS (
  SELECT source, source_size, least(level * weight, 2.0::DOUBLE * source_size) AS target FROM ordered, level
), rated AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, CAST(coalesce(floor(p.target / nullif(p.source_size, 0)), 0) AS BIGINT) AS whole,
         md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS h
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle FROM rated
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": OP1_SQL, "op10_line_dedup": OP10_SQL}
