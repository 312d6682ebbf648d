"""Stored layers of the broker accounts and their refresh: only symbols with new days are read, resumed from their open lots, and written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import events as ev
from flowlens.operators import fifo as ff
from flowlens.sources import tables as tb

_SUMS = "buy_shares long, sell_shares long, buy_amount double, sell_amount double"
#: Columns of each layer but for its partitions. `daily`, `closes` and `holdings` grow by one partition (symbol, as_of) a refresh; `lots` and `accounts` are whole in each.
#: `marks`, a row an account and date, are many times the days traded: they are not stored but laid out from `holdings` and `closes` when read.
LAYERS = {
    "daily": f"broker string, date date, {_SUMS}",
    "closes": "date date, close double",
    "holdings": "broker string, date date, realized_pnl double, net long, base double",
    "lots": "broker string, side string, shares long, cost_per_share double, open_date date",
    "accounts": "broker string, realized_pnl double, unrealized_pnl double, total_buy_amount double, total_sell_amount double, timing_alpha double, net long, base double",
}
_GROWING = ("daily", "closes", "holdings")


class Layers:
    """Tables under one folder, partitioned by symbol and the date up to which a refresh brought it.

    `progress` (symbol, as_of) says how far each symbol is; it is written last, so that rows of a refresh that did not end are not seen, and running it again
    writes the same partitions again. A symbol without new days keeps its files. Accounts are realised from `start` on, accounting begins with the first trade.
    """

    def __init__(self, spark: SparkSession, root: str, start: str = "1900-01-01"):
        self.spark, self.root, self.start = spark, root.rstrip("/"), start

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _raw(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def progress(self) -> DataFrame:
        return self._raw("progress", "as_of date, symbol string").select("symbol", "as_of")

    def read(self, name: str, progress: DataFrame | None = None) -> DataFrame:
        """A layer as far as refreshes have ended; of lots and accounts the last state of each symbol. `marks` are laid out from what accounts hold."""
        if name == "marks":
            progress = self.progress() if progress is None else progress
            return ff.held_marks(self.read("holdings", progress), self.read("closes", progress))
        raw = self._raw(name, f"{LAYERS[name]}, symbol string, as_of date")
        p = (self.progress() if progress is None else progress).select("symbol", F.col("as_of").alias("__done"))
        cond = F.col("as_of") <= F.col("__done") if name in _GROWING else F.col("as_of") == F.col("__done")
        return raw.join(p, "symbol").where(cond).drop("as_of", "__done")

    def _write(self, name: str, df: DataFrame, keys: tuple[str, ...] = ("symbol", "as_of")) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/{name}")

    def _staged(self, df: DataFrame, folder: str) -> DataFrame:
        path = f"{self.root}/_staged/{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def refresh(self, prints: DataFrame) -> dict[str, int]:
        """Take prints of days after what is stored for their symbol. Prints of days already stored are late: they are counted and left out.

        Rerun after a failure it takes the same rows again. Returns the numbers of symbols refreshed, account days taken and account days late.
        """
        folder, before = uuid.uuid4().hex, self._staged(self.progress(), "progress")
        daily = self._staged(tb.daily_summary(prints).join(before, "symbol", "left"), folder)
        is_new = F.col("as_of").isNull() | (F.col("date") > F.col("as_of"))
        n = daily.agg(F.count_if(is_new).alias("taken"), F.count_if(~is_new).alias("late"), F.count_distinct(F.when(is_new, F.col("symbol"))).alias("symbols")).first()
        if n.taken:
            fresh = daily.where(is_new).drop("as_of")
            after = self._staged(fresh.groupBy("symbol").agg(F.max("date").alias("as_of")), folder)
            dates = fresh.select("symbol", "date").distinct()
            closes = self._staged(tb.prices(prints.join(dates, ["symbol", "date"], "left_semi")).select("symbol", "date", "close"), folder)
            known = before.join(after.select("symbol"), "symbol", "left_semi")
            lots = self._staged(self.read("lots", known), folder)
            stamped = lambda df: df.join(after, "symbol")
            self._write("daily", stamped(fresh))
            self._write("closes", stamped(closes))
            self._write("holdings", stamped(ff.resumed_holdings(lots, fresh)))
            self._write("lots", stamped(ff.open_lots(ff.seeded(lots, fresh)).select("symbol", "broker", "side", "shares", "cost_per_share", "open_date")))
            self._write("accounts", stamped(self._accounts(known, after)))
            self._write("progress", after, ("symbol",))
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_staged")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return n.asDict()

    def _accounts(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Sums of each account of the symbols in `after`: the stored sums and those of the rows just written, and the mark at the last close of what it held last. Timing alpha needs all stored days of these symbols, but no prints."""
        late = F.col("date") >= F.lit(self.start).cast("date")
        new = lambda name: self._raw(name, f"{LAYERS[name]}, symbol string, as_of date").join(after, ["symbol", "as_of"], "left_semi")
        zero = F.lit(0.0)
        no_shares = F.lit(0).cast("long")
        made = new("holdings").select(*ff.ACCOUNT, F.when(late, F.col("realized_pnl")).otherwise(zero).alias("realized_pnl"), zero.alias("total_buy_amount"), zero.alias("total_sell_amount"), F.struct("date", "net", "base").alias("held"))
        nothing = F.lit(None).cast("struct<date:date,net:bigint,base:double>")
        days = new("daily").select(*ff.ACCOUNT, zero.alias("realized_pnl"), *[F.when(late, F.col(f"{s}_amount")).otherwise(zero).alias(f"total_{s}_amount") for s in ("buy", "sell")], nothing.alias("held"))
        old = self.read("accounts", before).select(*ff.ACCOUNT, "realized_pnl", "total_buy_amount", "total_sell_amount", F.struct(F.lit("0001-01-01").cast("date").alias("date"), "net", "base").alias("held"))
        sums = old.unionByName(made).unionByName(days).groupBy(*ff.ACCOUNT).agg(*[F.sum(c).alias(c) for c in ("realized_pnl", "total_buy_amount", "total_sell_amount")], F.max("held").alias("held"))
        last = new("closes").groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
        net, base = F.coalesce("held.net", no_shares), F.coalesce("held.base", zero)
        sums = sums.join(last, "symbol").select(*ff.ACCOUNT, "realized_pnl", (net * F.col("close") + base).alias("unrealized_pnl"), "total_buy_amount", "total_sell_amount", net.alias("net"), base.alias("base"))
        alpha = ev.timing_alpha(self.read("daily", after).where(late), self.read("closes", after).where(late))
        return sums.join(alpha, [*ff.ACCOUNT], "left").withColumn("timing_alpha", F.coalesce("timing_alpha", zero))

    def symbol_pnl(self) -> DataFrame:
        """Stored accounts with their place within the symbol."""
        return ff.symbol_ranking(self.read("accounts").withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl")))

    def ranking(self) -> DataFrame:
        """The market-wide ranking from stored accounts: no print, day or mark is read."""
        a = self.read("accounts").withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl"))
        return ff.market_ranking(a).join(a.groupBy("broker").agg(F.sum("timing_alpha").alias("timing_alpha")), "broker")


def follow(layers: Layers, source: str, schema, checkpoint: str) -> None:
    """Refresh layers with files of prints that have not been read yet. A batch that is run again after a failure changes nothing it had done."""
    stream = layers.spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(lambda batch, _: layers.refresh(batch)).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()
