import random

import numpy as np

from flowlens.llm import top_k as op
from flowlens.llm.queries import SQL, op6_exact_top_k


def brute(rows, k):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qi, q in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qi and len(v) == len(q))[:k]
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_brute(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_ROWS", 7)
    monkeypatch.setattr(op, "TILE_QUERIES", 2)
    monkeypatch.setattr(op, "FAN_IN", 3)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(350)] + [(400 + i, [0.5] * 4) for i in range(60)]
    rows += [(700, None), (701, [1.0, None, 1.0, 1.0]), (800, [float("nan")] * 4), (801, [float("inf")] * 4), (None, [9.0] * 4), (900, [1e12] * 4), (5, [0.25] * 4), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as grp", "2 as width")
    assert sorted(tuple(x) for x in op.top_k(df).collect()) == brute(rows, 10)
    assert op.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], df.schema[:2])
    assert sorted(tuple(x) for x in op.top_k(few).collect()) == brute(rows[:3], 10)


def test_tiles_follow_the_number_of_queries(spark, monkeypatch):
    """Where every row is a query, tiles hold no more than they should."""
    monkeypatch.setattr(op, "SHARD_ROWS", 64)
    monkeypatch.setattr(op, "TILE_QUERIES", 16)
    r = random.Random(2)
    rows = [(100 * i, [r.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sizes, product = spark.sparkContext.accumulator(0), op.product

    def counted(q, x):
        if len(q) > 40:  # 13 tiles of 200 queries dealt by a hash
            sizes.add(1)
        return product(q, x)

    monkeypatch.setattr(op, "product", counted)
    assert sorted(tuple(x) for x in op.top_k(df).collect()) == brute(rows, 10) and sizes.value == 0


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(c.sql("select query_id, rank, vec_id, score from (" + SQL["op6_exact_top_k"] + ")").fetchall())
    assert sorted(tuple(x) for x in op6_exact_top_k(spark, d).collect()) == want


def test_nothing_is_sent_through_the_driver_or_copied(spark, monkeypatch):
    """However small the queries look, they are not broadcast, and the rows that meet are dealt without a copy for each tile of the other side."""
    monkeypatch.setattr(op, "SHARD_ROWS", 64)
    monkeypatch.setattr(op, "TILE_QUERIES", 4)
    r = random.Random(3)
    rows = [(20 * i, [r.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    out = op.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
    assert sorted(tuple(x) for x in out.collect()) == brute(rows, 10)


def test_many_blocks_parts_and_ties(spark, monkeypatch):
    """Several blocks to a task, several tasks to a block, long vectors cut into smaller rows, equal scores all over."""
    for name, value in (("SHARD_ROWS", 8), ("TILE_QUERIES", 2), ("BLOCK_TILES", 2), ("TASK_BLOCKS", 3), ("PART_SHARDS", 2), ("LEAST_PARTS", 3), ("FAN_IN", 2), ("ENTRIES", 20)):
        monkeypatch.setattr(op, name, value)
    r = random.Random(4)
    rows = [(25 * i, [float(r.randrange(2)) for _ in range(r.choice((2, 3, 30)))]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in op.top_k(df).collect()) == brute(rows, 10)


def test_product_is_exact_in_every_precision():
    rng = np.random.default_rng(5)
    for top in (100, 2**11, 2**13, 2**24, 2**28, 2**40):
        q, x = (np.floor(rng.uniform(-top, top, (5, 64))) for _ in range(2))
        want = [[sum(int(a) * int(b) for a, b in zip(i, j)) for j in x] for i in q]
        assert np.array_equal(op.product(q, x), np.clip(np.array(want, dtype=object), -(2**63), 2**63 - 1).astype(np.int64))
