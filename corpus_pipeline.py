"""A training-corpus pipeline: five operators of ``tidemark.llm``, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as
Parquet in the shared folder and reads it as the next one's input.

Every stage takes documents with null or repeated doc_ids, null or empty texts
and extra columns (which go), and empty tables:

* quality: each row is scored by itself, a null text as an empty one;
* lines: each row is a document; a null text comes back empty;
* near duplicates: a document is a doc_id (or none) with a text; one row of each group stays;
* mix: rows that agree in doc_id, text and source share what they are taken;
* pack: each row is a document, a null text the end id alone.

``tag`` names the folder of a stage's scratch tables; ``run`` gives every stage
of every run one of its own and deletes it when the stage's result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, golay_simhash, line_dedup, mixing, packing, quality_gam
from tidemark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.3) go."""
    scored = quality_gam.classify(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Lines that ten or more documents share go; the documents stay, with their new length."""
    kept = line_dedup.drop_common_lines(docs.select(*COLUMNS), tag=tag)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays (none last)."""
    return golay_simhash.drop_near_duplicates(docs.select(*COLUMNS), words_per_shingle=5, similarity=0.8, tag=tag).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """Sources at weights 5, 2, 1 by code point make up 150 % of the words; a document comes up to twice."""
    key = lambda rows: rows.select(*COLUMNS, F.xxhash64("doc_id", "text", "source").alias("row_key"))
    sized = common.table(key(docs).select("doc_id", "source", mixing.word_count("text").alias("size"), "row_key"), tag or common.new_tag("mixing"))
    mixed = mixing.mix(sized, mixing.cyclic_weights(sized), share=1.5, max_epochs=2, tag=tag)
    taken = mixed.groupBy("row_key").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = key(docs)
    repeated = sized.groupBy("row_key").count().filter("count > 1").limit(1).count()
    rows = rows.dropDuplicates(["row_key"]) if repeated else rows
    # rows that agree are interchangeable: one of them stands for all and is repeated as often as they are taken together
    return rows.join(taken, "row_key").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tag: str | None = None) -> DataFrame:
    """All documents of the mix packed into sequences of up to 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path(), tag=tag)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Classifier, fingerprints and tokenizer can't be expressed in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last stage's result stays in the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        scratch, out = common.new_tag(name), common.new_tag(f"out_{name}")
        docs = common.table(stage(spark, docs, sf_dir, tag=scratch), out)
        for tag in (scratch, before):
            if tag:
                common.release(spark, tag)
        before = out
    return docs
