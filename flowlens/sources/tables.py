"""Domain tables derived from the given ones: prints, daily summary, prices, ticks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade prints: symbol, broker, date, price, buy, sell (shares) and the order key of each."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    q = F.col("l_quantity").cast("long")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("broker"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_linestatus") == "O", q).otherwise(F.lit(0)).cast("long").alias("buy"),
        F.when(F.col("l_linestatus") == "F", q).otherwise(F.lit(0)).cast("long").alias("sell"), "l_orderkey", "l_linenumber",
    )


def daily_summary(p: DataFrame) -> DataFrame:
    """One row for each symbol, broker and day (one shuffle, sums combined before it)."""
    return p.groupBy("symbol", "broker", "date").agg(
        F.sum("buy").alias("buy_shares"), F.sum("sell").alias("sell_shares"), F.sum(F.col("buy") * F.col("price")).alias("buy_amount"), F.sum(F.col("sell") * F.col("price")).alias("sell_amount")
    )


def prices(p: DataFrame) -> DataFrame:
    """Daily open, high, low, volume-weighted close and volume of each symbol."""
    key = F.struct("l_orderkey", "l_linenumber")
    shares = F.col("buy") + F.col("sell")
    return p.groupBy("symbol", "date").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), (F.sum(shares * F.col("price")) / F.sum(shares)).alias("close"), F.sum(shares).alias("volume")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("broker"), "ts", F.col("value").alias("price"))


def clean_prints(raw: DataFrame) -> DataFrame:
    """Prints whose price is text: rows marked '-' (proprietary) go, thousands separators are taken out, UTC instants become Taipei trading dates."""
    kept = raw.where(F.col("price") != "-")
    day = F.to_date(F.from_utc_timestamp("ts", "Asia/Taipei"))
    return kept.withColumn("price", F.regexp_replace("price", ",", "").try_cast("double")).withColumn("date", day)


def map_table(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of strings as a two-column table."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def nested_prints(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows with a list of price levels, one row for each level."""
    schema = "date string, symbol_id string, broker string, data array<struct<price:string,buy:long,sell:long>>"
    return spark.read.schema(schema).json(path).select("date", "symbol_id", "broker", F.explode("data").alias("level")).select("date", "symbol_id", "broker", "level.*")


def trade_log(spark: SparkSession, path: str) -> DataFrame:
    """A trade log in CSV; a missing column raises ValueError."""
    need = {"date": "string", "symbol": "string", "direction": "string", "hold_seconds": "long", "net_bps": "double"}
    df = spark.read.csv(path, header=True)
    if missing := sorted(set(need) - set(df.columns)):
        raise ValueError(f"columns missing: {missing}")
    return df.select([F.col(c).try_cast(t).alias(c) for c, t in need.items()])


def write_by_symbol(df: DataFrame, path: str) -> None:
    """One folder for each symbol, the rows of each file in order of broker and date. Rows are dealt by ranges of symbol and broker, so that a hot symbol is written by several tasks."""
    df.repartitionByRange("symbol", "broker").sortWithinPartitions("symbol", "broker", "date").write.mode("overwrite").partitionBy("symbol").parquet(path)


def save_report(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv",)) -> None:
    for f in formats:
        w = df.write.mode("overwrite")
        {"csv": lambda w=w: w.option("header", True).csv(f"{path}.csv"), "parquet": lambda w=w: w.parquet(f"{path}.parquet"), "json": lambda w=w: w.json(f"{path}.json")}[f]()


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under `spark.checkpoint.dir`, which driver and executors share. Only a session on this machine alone may leave that unset; it then takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written once as a table that several parts of a job read, so that none computes it again."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def closure(mapping: DataFrame) -> DataFrame:
    """Chains of a mapping (key, to) followed to their ends: (key, to), no `to` being a key. A key that leads back to itself raises ValueError.

    Each round doubles the steps taken, so that a chain of n links takes about log2(n) joins; each round is written, so that none is computed again. More rounds than log2 of the rows mean a cycle.
    """
    spark = mapping.sparkSession
    folder, r = workspace(spark, "closure"), 0
    m = stored(mapping.select("key", "to"), folder, "0")
    most = max(m.count(), 1).bit_length() + 1
    while True:
        if not m.where("key = to").isEmpty():
            raise ValueError("a key leads back to itself")
        if m.join(m.select(F.col("key").alias("to")), "to", "left_semi").isEmpty():
            return m
        r += 1
        if r > most:
            raise ValueError("a key leads back to itself")
        on = m.select(F.col("key").alias("to"), F.col("to").alias("further"))
        m = stored(m.join(on, "to", "left").select("key", F.coalesce("further", "to").alias("to")), folder, str(r))


def day_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All day files that a pattern matches, read with a given schema, so that none is opened to find it."""
    return spark.read.schema(schema).parquet(pattern)


def every_symbol(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The tables of all symbols under one folder (symbol=.../), each row with its symbol as text, whatever it looks like."""
    return spark.read.schema(f"{schema}, symbol string").parquet(root)
