"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. The session then sends
rows to Python workers in batches of ``BATCH_BYTES`` and ``BATCH_ROWS`` at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.llm import decontam, jaccard, langid, line_dedup, packing
from cohortcast.llm.blooms import parted, without
from cohortcast.llm.common import stage

#: Rows that must share a line before only the first keeps it.
LINE_DOCS = 10
#: Words from which a line is a passage, and rows that must share it before only the first keeps it.
PASSAGE_WORDS, PASSAGE_DOCS = 51, 2
#: Bytes and rows of a batch on its way to a Python worker; the default holds ten thousand texts, however long.
#: The texts of a batch wait in the JVM for its results, even if the worker gets their hashes alone.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1000
#: Near duplicates: words of a shingle, percent of shared ones.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _small_batches(spark: SparkSession) -> None:
    """Bound what an executor and its Python workers hold of a stage's texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key of id and text (128 bits of hash), and its name: equal for equal rows only."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    hashes = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    return docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *hashes)), name


def _counted(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``kept``, with n_chars of the text that is left."""
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; without letters or sure language they go."""
    _small_batches(spark)
    return langid.identify(docs, sure=True).filter("lang_sure").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ``LINE_DOCS`` or more documents stay only where they come first; n_chars follows.

    A document that loses all its lines stays as an empty one.
    """
    _small_batches(spark)
    return _counted(line_dedup.dedup_lines(docs, min_docs=LINE_DOCS, keep="first"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id, then passages once.

    Rows without doc_id come last; of rows with the same id and text one stays. A passage is a line of
    ``PASSAGE_WORDS`` or more words; of ``PASSAGE_DOCS`` documents left that hold it
    only the first keeps it. Before the copies went, they would lose their passages and be near no more: what
    they keep of their own would stay.
    """
    _small_batches(spark)
    rows, key = _keyed(docs)
    found = jaccard.near_texts(rows.select(key, "text"), percent=NEAR_PERCENT, words=NEAR_WORDS, id_col=key).filter("n_shingles > 0")
    groups = found.groupBy(key).agg(F.min("component_id").alias("group"), F.count("*").alias("n"))
    groups = groups.join(rows.select(key, "doc_id").groupBy(key).agg(F.min("doc_id").alias("doc_id")), key)
    groups = stage(groups, "near_groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    first = groups.groupBy("group").agg(F.min(place)[key].alias(key))
    repeated = stage(groups.filter("n > 1").select(key).join(first, key, "left_semi"), "near_repeated")
    gone = stage(groups.select(key).join(first, key, "left_anti").unionByName(repeated), "near_copies")
    again = parted(rows, repeated, key)[1].join(repeated, key, "left_semi").dropDuplicates([key])
    left = without(rows, gone, key).unionByName(stage(again.select(rows.columns), "near_once")).drop(key)
    return _counted(line_dedup.dedup_lines(left, min_docs=PASSAGE_DOCS, keep="first", min_words=PASSAGE_WORDS), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; every row is judged by its own text."""
    _small_batches(spark)
    rows, key = _keyed(docs)
    found = decontam.find_passages(rows.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    hit = stage(found.filter("n_hit > 0").select(key).distinct(), "passage_hits")
    return without(rows, hit, key).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's place in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("benchmark_passages", benchmark),
    ("best_fit_packing", sequences),
]

#: A learned network decides in the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
