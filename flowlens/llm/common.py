"""Helpers shared by the training-data operators: scratch tables, word splitting, hashing, native `let`."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class (fixed value).
BLANKS = "[\\x20\\x09-\\x0D]"
_TRIM = " \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: The least number of files of a table whose number of rows is known.
FEW_FILES = 8
#: Whether Spark deletes the shuffle files of an execution as soon as it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the folder that driver and executors share, to cut lineage so that a lost executor costs no recomputation.

    The folder is the session's `spark.checkpoint.dir`, which a cluster must set. Where it is unset, a session on this machine alone (local[n]) takes a temporary one; any other stops.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="flowlens-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root, self.paths = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
        """Write df as Parquet and return the table read back. Where a bound on its rows is known, small tables are written in few files, large ones by all partitions.

        The write's shuffle files go with it, as nothing reads them again: left to the collector, those of one table are still there while the next is made.
        """
        if rows is not None:
            df = df.coalesce(max(FEW_FILES, -(-rows // per_file)))
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            _, path = self.paths.pop(id(t))
            self.delete(path)

    def only(self, *tables: DataFrame) -> None:
        """Delete every table of this folder that none of the given plans reads, and let Spark free what belonged to them."""
        read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for t in tables for f in t.inputFiles()}
        for key, (_, path) in list(self.paths.items()):
            if path.split(":", 1)[-1].lstrip("/") not in read:
                del self.paths[key]
                self.delete(path)
        gc.collect()
        self.spark._jvm.System.gc()  # shuffle files go with the plans that are no longer held

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body) -> Column:
    """Bind a costly expression once and use it often in body, which lambdas would otherwise evaluate for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are computed once, however often later columns and filters use them: the optimizer moves nothing through a generator."""
    for name, value in values.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def words(text: Column) -> Column:
    """Native array of the words of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(text, F.lit(_TRIM))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS + "+"))


def split_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """The same words as `words`, in Python over UTF-8 bytes; bytes.split() cuts at exactly these six characters."""
    if not text:
        return []
    return (text.translate(_LOWER) if lower else text).split()


class WordHashes(dict):
    """word -> 64-bit hash, kept for frequent words; forgets all when it holds `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def small_batches(batches, rows: int = 256):
    """Cut Arrow batches so that a Python worker holds few decoded texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
