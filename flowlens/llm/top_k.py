"""Operator 6: exact top-k inner-product search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a shard and queries of a tile; a product is made of one of each. Lists merged at once on the way up the tree.
SHARD_ROWS, TILE_QUERIES, FAN_IN = 4096, 512, 16
#: A packed row of queries is a block of so many tiles; a task meets at most about so many blocks with one part, and a part is so many shards; the least number of parts, where there are so many shards.
BLOCK_TILES, TASK_BLOCKS, PART_SHARDS, LEAST_PARTS = 8, 16, 64, 32
#: Components of a packed row at most (where a vector holds no more by itself).
ENTRIES = 2**19


_PACKED = pa.schema([("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("m", pa.binary())])


def _packed(held: list[pa.RecordBatch], most: int, entries: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) packed: ids and integer components of vectors of one length, both as bytes, ordered by vec_id; components take the least room that holds them."""
    t = pa.Table.from_batches(held)
    ids, v = t.column("vec_id").to_numpy().astype(np.int64), t.column("v").combine_chunks()
    widths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = np.floor(1024.0 * v.flatten().to_numpy(zero_copy_only=False)), np.cumsum(widths) - widths
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        own = own[np.argsort(ids[own], kind="stable")]
        for part in np.array_split(own, -(-len(own) // max(1, min(most, entries // int(w))))):
            m = flat[starts[part][:, None] + np.arange(w)]
            top = np.abs(m).max()
            kind = "i2" if top < 2**15 else "i4" if top < 2**31 else "f8"
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([kind]), pa.array([ids[part].tobytes()], pa.binary()), pa.array([m.astype(kind).tobytes()], pa.binary())], schema=_PACKED)


def _pack(most: int, entries: int):
    """Packs what a task reads, `most` rows at a time; less, where vectors are so long that they hold more than `entries` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, most):
                held.append(b.slice(at, most))
                rows, size = rows + held[-1].num_rows, size + len(held[-1].column("v").flatten())
                if rows >= most or size >= entries:
                    yield from _packed(held, most, entries)
                    held, rows, size = [], 0, 0
        if held:
            yield from _packed(held, most, entries)

    return run


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer product as int64: in floating point where no sum can pass 2^53 (2^24 in single precision), else in integers."""
    if np.sqrt((q * q).sum(axis=1).max(initial=0) * (x * x).sum(axis=1).max(initial=0)) < 2**24 - 1:  # no partial sum passes the product of the lengths
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    if top < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = q.astype(object) @ x.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def select(qid: int, ids: np.ndarray, s: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one query among `best` and the scores of a shard: higher score first, then smaller vec_id; rows with the query's own id are left out. ids ascend."""
    other = ids != qid
    ids, s = ids[other], s[other]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
        pick = np.concatenate([above, equal[: k - len(above)]])
        ids, s = ids[pick], s[pick]
    ids, s = np.concatenate([best[0], ids]), np.concatenate([best[1], s])
    order = np.lexsort((ids, ~s))[:k]
    return ids[order], s[order]


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, blocks = (np.empty(0, np.int64), np.empty(0, np.int64)), {}
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                w, x_ids, q_ids = row["width"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                x, q = (np.frombuffer(row[m], row[kind]).reshape(-1, w).astype(float) for m, kind in (("m", "kind"), ("q_m", "q_kind")))
                _, best, least = blocks.setdefault((row["part"], row["block"]), (q_ids.copy(), [none] * len(q_ids), np.full(len(q_ids), -(2**63), np.int64)))
                for at in range(0, len(q_ids), TILE_QUERIES):
                    scores = product(q[at : at + TILE_QUERIES], x)
                    for i in np.flatnonzero(scores.max(axis=1) >= least[at : at + TILE_QUERIES]):
                        near = np.flatnonzero(scores[i] >= least[at + i])
                        best[at + i] = own = select(q_ids[at + i], x_ids[near], scores[i][near], best[at + i], k)
                        if len(own[1]) == k:
                            least[at + i] = own[1][-1]
        for (part, _), (q_ids, best, _) in blocks.items():
            qs, (xs, ss) = np.repeat(q_ids, [len(x) for x, _ in best]), (np.concatenate(c) for c in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(np.full(len(qs), part), pa.int64()), pa.array(xs, pa.int64()), pa.array(ss, pa.int64())], names=["query_id", "part", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """Exact k best rows by integer inner product of floor(1024 x) for each query (rows whose vec_id is divisible by `every`).

    Returns query_id, rank (from 1), vec_id, score. Vectors are packed where they are read, SHARD_ROWS to a shard, queries
    BLOCK_TILES x TILE_QUERIES to a block, and dealt to parts. A task meets a part of shards with some blocks (a product of
    partitions): every row is shuffled once, packed, and none is copied for other tiles nor sent through the driver. It keeps
    the k best of each of its queries as shards go by; lists of parts meet FAN_IN at a time.

    Vectors that are null or hold null or non-finite components, and null ids, take no part. Vectors of another length
    than the query's are no candidates. Rows that repeat a query's vec_id are not candidates of that query; a repeated
    id counts once as a query, and repeated other rows are candidates each. Extra columns are ignored. No queries or candidates: no rows.
    Scores beyond 64 bits stand as the largest or smallest long.
    """
    asks = F.pmod("vec_id", F.lit(every)) == 0
    n, n_queries = vectors.agg(F.count("vec_id"), F.count_if(asks)).first()  # at most; only the numbers of parts follow
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("embedding") > 0)
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    def packed(df: DataFrame, most: int, parts: int) -> DataFrame:
        return df.mapInArrow(_pack(most, ENTRIES), "width int, kind string, ids binary, m binary").repartition(parts)

    shards, block = -(-n // SHARD_ROWS), BLOCK_TILES * TILE_QUERIES
    parts = max(1, min(shards, LEAST_PARTS), -(-shards // PART_SHARDS))
    x = packed(rows, SHARD_ROWS, parts).withColumn("part", F.spark_partition_id())
    q = packed(rows.where(asks).dropDuplicates(["vec_id", "v"]), block, max(1, -(-n_queries // (block * TASK_BLOCKS))))
    q = q.withColumnsRenamed({"kind": "q_kind", "ids": "q_ids", "m": "q_m"}).withColumn("block", F.monotonically_increasing_id())
    best = x.hint("shuffle_replicate_nl").join(q.hint("shuffle_replicate_nl"), "width").mapInArrow(_tiles(k), "query_id long, part long, vec_id long, score long")
    by_rank = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    while parts > FAN_IN:
        best = best.withColumn("part", F.floor(F.col("part") / FAN_IN)).withColumn("rank", F.row_number().over(by_rank("query_id", "part"))).where(F.col("rank") <= k).drop("rank")
        parts = -(-parts // FAN_IN)
    return best.withColumn("rank", F.row_number().over(by_rank("query_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
