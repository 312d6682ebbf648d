import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import fifo as ff
from flowlens.operators import holdings as ho
from flowlens.sources import tables as tb
from flowlens.streaming import accounts as ac
from flowlens.streaming.layers import Layers, follow

SCHEMA = "symbol string, broker string, date date, price double, buy long, sell long, l_orderkey long, l_linenumber long"


def make(spark, seed=1, symbols=("A", "0050", "C"), days=60):
    r = random.Random(seed)
    d0, rows = dt.date(2020, 1, 1), []
    for s in symbols:
        for i in range(days):
            for b in "xyzuv":
                if r.random() < 0.35:
                    q = r.randrange(1, 9)
                    rows.append((s, b, d0 + dt.timedelta(days=i), r.choice([10.0, 11.5, 9.25, 12.0]), q if r.random() < 0.5 else 0, r.randrange(1, 9), len(rows), 1))
    return spark.createDataFrame(rows, SCHEMA)


def key(df, cols, n=6):
    return sorted(tuple(round(x, n) + 0.0 if isinstance(x, float) else x for x in r) for r in df.select(cols).collect())


def files(root, symbol):
    return sorted(os.path.join(a, f) for a, _, fs in os.walk(root) for f in fs if f"symbol={symbol}" in a and f.endswith(".parquet"))


def test_resumed_equals_whole(spark):
    """D1, marks and lots from open lots at a date and the days after it, against all of the history; accounts that do not trade again included."""
    p = make(spark)
    daily, prices = tb.daily_summary(p).cache(), tb.prices(p).cache()
    for cut in ("2019-12-01", "2020-01-20", "2020-02-27"):
        old, new = daily.where(f"date <= '{cut}'"), daily.where(f"date > '{cut}'")
        lots = ff.open_lots(old)
        cols = ["symbol", "broker", "date", "realized_pnl", "unrealized_pnl", "net"]
        assert key(ff.resumed_daily(lots, new, prices), cols) == key(ff.fifo_daily(daily, prices).where(f"date > '{cut}'"), cols)
        assert key(ff.open_lots(ff.seeded(lots, new)), ["symbol", "broker", "side", "shares", "cost_per_share", "open_date"]) == key(ff.open_lots(daily), ["symbol", "broker", "side", "shares", "cost_per_share", "open_date"])
        assert key(ff.resumed_marks(lots, new, prices.where(f"date > '{cut}'")), cols[:5]) == key(ho.daily_marks(daily, prices).where(f"date > '{cut}'"), cols[:5])


@pytest.fixture
def whole(spark, tmp_path):
    full = Layers(spark, f"file://{tmp_path}/full", "2020-01-10")
    full.refresh(make(spark))
    return full


LAYER_COLS = {"marks": ["symbol", "broker", "date", "realized_pnl", "unrealized_pnl"], "lots": ["symbol", "broker", "side", "shares", "cost_per_share", "open_date"], "daily": ["symbol", "broker", "date", "buy_shares", "sell_amount"]}
RANKING = ["broker", "rank", "total_pnl", "realized_pnl", "unrealized_pnl", "total_buy_amount", "total_amount", "timing_alpha"]


def same(a, b):
    assert all(key(a.read(n), c) == key(b.read(n), c) for n, c in LAYER_COLS.items())
    assert key(a.ranking(), RANKING, 5) == key(b.ranking(), RANKING, 5)
    assert key(a.symbol_pnl(), ["symbol", "broker", "rank", "total_pnl", "timing_alpha"], 5) == key(b.symbol_pnl(), ["symbol", "broker", "rank", "total_pnl", "timing_alpha"], 5)


def test_refresh_equals_rebuild(spark, tmp_path, whole):
    """Three refreshes against one; a symbol without new days keeps its files; a rerun and late rows change nothing and are counted."""
    p = make(spark)
    step = Layers(spark, f"file://{tmp_path}/step", "2020-01-10")
    assert step.refresh(p.where("date <= '2020-01-20'"))["late"] == 0
    before = files(f"{tmp_path}/step", "C")
    step.refresh(p.where("date <= '2020-02-10' and symbol <> 'C'"))
    assert before and files(f"{tmp_path}/step", "C") == before
    step.refresh(p)
    same(step, whole)
    counts = step.refresh(p)
    assert counts["taken"] == 0 and counts["symbols"] == 0 and counts["late"] == step.read("daily").count()
    same(step, whole)
    assert step.refresh(p.limit(0)) == {"taken": 0, "late": 0, "symbols": 0}


@pytest.mark.parametrize("layer", ["lots", "progress"])
def test_killed_refresh_runs_again(spark, tmp_path, whole, layer):
    """A refresh that dies before a layer is written is not seen, and the next one brings the same result."""
    p = make(spark)
    step = Layers(spark, f"file://{tmp_path}/{layer}", "2020-01-10")
    step.refresh(p.where("date <= '2020-01-25'"))
    shown = key(step.ranking(), RANKING)
    write = step._write

    def dies(name, *args):
        if name == layer:
            raise RuntimeError("lost")
        write(name, *args)

    step._write = dies
    with pytest.raises(RuntimeError):
        step.refresh(p)
    assert key(step.ranking(), RANKING) == shown
    step._write = write
    step.refresh(p)
    same(step, whole)


def test_follow_day_files(spark, tmp_path, whole):
    p = make(spark)
    layers = Layers(spark, f"file://{tmp_path}/followed", "2020-01-10")
    for i, cond in enumerate(["date <= '2020-01-15'", "date between '2020-01-16' and '2020-02-01'", "date > '2020-02-01'"]):
        p.where(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(layers, f"{tmp_path}/in", p.schema, f"{tmp_path}/checkpoint")
    same(layers, whole)


def test_stream_of_accounts_resumes(spark, tmp_path):
    """Three slices of days fed one after another, the query stopped and started anew in between, equal D1 over all; a late row changes nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    p = make(spark, symbols=("A", "B"), days=30)
    daily, prices = tb.daily_summary(p), tb.prices(p)
    rows = daily.join(prices.select("symbol", "date", "close"), ["symbol", "date"]).cache()
    late = rows.where("date = '2020-01-03'").withColumn("buy_shares", F.col("buy_shares") + 100)
    for part in (rows.where("date <= '2020-01-10'"), rows.where("date between '2020-01-11' and '2020-01-20'"), rows.where("date > '2020-01-20'").unionByName(late)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/days")
        q = ac.fifo_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/days")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    cols = ["symbol", "broker", "date", "realized_pnl", "unrealized_pnl", "net"]
    assert key(spark.read.parquet(f"{tmp_path}/out"), cols) == key(ff.fifo_daily(daily, prices), cols)


def test_a_refresh_stores_days_and_not_marks(spark, tmp_path):
    """What is stored grows with days traded, not with accounts times dates; marks read from it are those of the whole history."""
    p = make(spark, symbols=("A",), days=20)
    step = Layers(spark, f"file://{tmp_path}/sparse", "2020-01-01")
    step.refresh(p.where("date <= '2020-01-10'"))
    step.refresh(p)
    assert not os.path.exists(f"{tmp_path}/sparse/marks") and step.read("holdings").count() == step.read("daily").count()
    assert key(step.read("marks"), LAYER_COLS["marks"]) == key(ho.daily_marks(tb.daily_summary(p), tb.prices(p)), LAYER_COLS["marks"])


def test_state_is_the_last_of_the_days(spark):
    """Sums over an account's days give what its days one by one give, from a start on as well, without meeting another shuffle than that of the accounts."""
    p = make(spark, symbols=("A", "B"), days=30)
    daily, prices = tb.daily_summary(p.repartition(3, "symbol", "broker")), tb.prices(p).cache()
    got = {(x.symbol, x.broker): x for x in ff.last_state(daily, prices, "2020-01-15").collect()}
    want, close = {}, {s: c for s, c in prices.groupBy("symbol").agg(F.max_by("close", "date")).collect()}
    for x in sorted(ff.fifo_daily(daily, prices).collect(), key=lambda x: x.date):
        late = want.get((x.symbol, x.broker), (0.0,))[0] + (x.realized_pnl if x.date >= dt.date(2020, 1, 15) else 0.0)
        want[x.symbol, x.broker] = (late, x.realized_total, x.net * (close[x.symbol] - x.close) + x.unrealized_pnl)
    assert got.keys() == want.keys()
    assert all((got[k].late_pnl, got[k].realized_pnl, got[k].unrealized_pnl) == pytest.approx(v, abs=1e-6) for k, v in want.items())
