"""A corpus pipeline: language, repeated lines, near-duplicates, mixing, tokens. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.bpe import encode_digests
from flowlens.llm.common import Scratch
from flowlens.llm.lang_id import identify
from flowlens.llm.line_dedup import without_duplicate_lines
from flowlens.llm.mixing import mixed_documents
from flowlens.llm.near_dedup import near_duplicates


#: The columns that operators know; others are renamed for a stage, so that none clashes with what it adds.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(docs: DataFrame, stage) -> DataFrame:
    """stage(docs) for a stage that returns the columns of docs, with columns it does not know under names of their own meanwhile."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
    out = stage(docs.withColumnsRenamed(names)).select([names.get(c, c) for c in docs.columns])
    return out.withColumnsRenamed({v: k for k, v in names.items()})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; texts that are null, without letters or rejected go.

    Rows are judged one by one: repeated rows share a verdict, null ids stay, an empty table stays empty. Columns of any name pass through.
    """
    return guarded(docs, lambda d: identify(d, keep=d.columns).where(~F.col("rejected")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, near copies of lines included; documents left without a visible line go.

    Null and blank texts stay as they are, a null id comes first, rows that repeat id and text keep the same lines, an empty table stays empty. Columns of any name pass through.
    """
    return guarded(docs, without_duplicate_lines)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, from similarity 0.8 on.

    Rows are told apart by a key of their own, so that null ids stay and of repeated rows one is kept, whatever their ids. The row with the smallest id stays (null last, ties by a hash of the text), so that reruns agree.
    Null and blank texts stay, an empty table stays empty, columns of any name pass through.
    """
    keyed = row_keys(docs, Scratch(spark, "row-keys"))
    found = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"), percent=80)
    ranks = keyed.select("__row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row").alias("rank"))
    members = found.select(F.col("doc_id").alias("__row"), "component_id").join(ranks, "__row")
    kept = members.groupBy("component_id").agg(F.min_by("__row", "rank").alias("__row")).select("__row")
    return keyed.join(kept, "__row", "left_semi").select(docs.columns)


def row_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with a number __row of its own for every row, kept as a table so that it does not change when the plan runs again."""
    return scratch.keep(docs.withColumn("__row", F.monotonically_increasing_id()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each use of a document, with the words taken.

    Documents without words are not taken. A null source is a source of its own. Repeated rows are documents each. An empty table stays empty. Columns of any name pass through.
    """
    return guarded(docs, mixed_documents)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; a null text counts as empty, repeated rows are encoded each, extra columns are dropped."""
    import public_tokenizers

    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicate_documents), ("mixing", mixing), ("tokens", tokens)]
#: The language and token stages have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
