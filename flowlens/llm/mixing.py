"""Operator 4: mixing sources to target weights, block by block, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, let, words

#: Weights that sources take in turn, and the share of all words that the mix holds (fixed values of the contract).
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words of a block, slots of an output shard, shards behind one row of the running numbers, documents behind a bucket of the running totals, slots drawn by a quarter of a task, cells of the look-up of a draw, and rounds of the index permutations.
BLOCK, SHARD_SLOTS, SHARD_GROUP, BUCKET_DOCS, CHUNK_SLOTS, CELLS, ROUNDS = 32, 4096, 4096, 4096, 65_536, 65_536, 8


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for any n: swap-or-not, in each round x and its mirror change places if a bit of their hash is set."""

    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(seed, r), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, mirror), seed, r).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(at)

    # at most ROUNDS evaluations a row; the fold keeps each round's value bound
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def source_targets(sizes: DataFrame) -> list[tuple]:
    """(source, size, target) from a table of (source, size), one row for each source, in order of code point, null last.

    A source's share goes by weight; what passes MOST times its size is dealt again by weight among those below, until none is above.
    Weights recur by place, so this runs over the sorted list of sources, a few numbers for each; documents are not involved.
    """
    rows = sorted(((r.source, int(r.size)) for r in sizes.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    total = SHARE * sum(n for _, n in rows)
    targets: dict[int, float] = {}
    left, open_ = total, list(range(len(rows)))
    while open_:
        weight = sum(WEIGHTS[i % len(WEIGHTS)] for i in open_)
        full = [i for i in open_ if left * WEIGHTS[i % len(WEIGHTS)] / weight >= MOST * rows[i][1]]
        if not full:
            targets |= {i: left * WEIGHTS[i % len(WEIGHTS)] / weight for i in open_}
            break
        targets |= {i: MOST * rows[i][1] for i in full}
        left -= sum(MOST * rows[i][1] for i in full)
        open_ = [i for i in open_ if i not in targets]
    return [(s, n, float(targets[i])) for i, (s, n) in enumerate(rows)]


class Mixture:
    """The parts of one mix. `pieces`: every part of a document that falls in one block of its source; `slots`: the output's blocks in order."""

    def __init__(self, docs: DataFrame, seed: int = 0):
        spark = docs.sparkSession
        self.scratch = scratch = Scratch(spark, "mixing")
        text = F.col("text").cast("string")
        base = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("h"), F.size(words(text)).cast("long").alias("size"))
        count = docs.count()
        buckets = max(1, -(-count // BUCKET_DOCS))
        base = scratch.keep(base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(buckets))))
        sums = scratch.keep(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
        targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("size")))
        self.targets, start, rows = targets, 0, []
        for i, (s, n, t) in enumerate(targets):
            blocks = -(-n // BLOCK)
            # whole slots, so that the source's words meet its target; never more than two uses of a block
            slots = min(round(t * blocks / n), 2 * blocks) if n else 0
            rows.append((s, i, n, t, blocks, slots, start))
            start += slots
        self.n_slots, self.slots_of = start, [(r[1], r[5]) for r in rows]
        self.sources = spark.createDataFrame(rows, "source string, no int, source_size long, target double, blocks long, slots long, first_slot long").coalesce(1)
        #: One row for each source, a few numbers wide: broadcast only up to so many sources.
        self.few = len(rows) <= 100_000
        small = F.broadcast(self.sources) if self.few else self.sources
        # documents in a fixed random order within their source: running words of buckets, then within a bucket
        before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        at = sums.withColumn("bucket_start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
        inside = W.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "h")
        placed = base.withColumn("row", F.row_number().over(inside)).withColumn("inner", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        same = placed.source.eqNullSafe(at.source) & (placed.bucket == at.bucket)
        placed = placed.join(at, same).select(placed.source, placed.bucket, "row", "doc_id", "h", "size", (F.col("bucket_start") + F.col("inner")).alias("start"))
        placed = placed.join(small, placed.source.eqNullSafe(small.source), "left").drop(self.sources.source)
        self.placed = placed.select("no", "bucket", "row", "doc_id", "h", "size", "start", "source_size", "target")
        block = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
        pieces = self.placed.withColumn("block", block)
        low = F.greatest(F.col("start"), F.col("block") * BLOCK)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
        self.pieces = pieces.withColumn("from", low - F.col("start")).withColumn("n", high - low)
        #: (shard, no, drawn): the multinomial counts. (shard, no, first, n): runs of a source's slot numbers that a shard takes.
        self.draws, self.runs = self.drawn(spark, seed)
        ahead = W.partitionBy("shard").orderBy("no", "first").rowsBetween(W.unboundedPreceding, -1)
        wide = F.least(F.lit(SHARD_SLOTS).cast("long"), self.n_slots - F.col("shard") * SHARD_SLOTS)
        # runs are few and long: a stated number of tasks keeps them from being made into slots in one
        spread = self.runs.repartition(max(8, self.n_slots // CHUNK_SLOTS // 4), "shard")
        laid = spread.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        blocks = self.sources.select("no", "blocks")
        laid = laid.join(F.broadcast(blocks) if self.few else blocks, "no")
        slot = F.col("shard") * SHARD_SLOTS + permuted(F.col("offset") + F.col("k"), wide, F.xxhash64(F.lit(seed + 1), "shard"))
        number = F.col("first") + F.col("k")
        use = F.floor(number / F.col("blocks"))
        index = permuted(number - use * F.col("blocks"), F.col("blocks"), F.col("no") * 2 + 1000 + seed)
        #: (slot, shard, no, block, use): the output's blocks in order.
        self.slots = laid.select(slot.alias("slot"), "shard", "no", index.alias("block"), (use + 1).alias("use"))
        #: (no, block, uses): how often the mix takes each block.
        self.uses = scratch.keep(self.slots.groupBy("no", "block").agg(F.count("*").alias("uses")))

    def drawn(self, spark, seed: int) -> tuple[DataFrame, DataFrame]:
        """Draws of every shard and the runs of slot numbers that follow from them.

        Every output slot falls on a source by a draw of its own, with probability in proportion to the sources' slots; counted by shard this is a multinomial draw.
        A source's slots are numbered through its shards in order. Numbers beyond the source's slots (about the root of all slots, in its last shards)
        go to the sources that were drawn too seldom, so that totals are met and no block is used more than twice.
        """
        n = self.n_slots
        if not n:
            return spark.createDataFrame([], "shard long, no int, drawn long"), spark.createDataFrame([], "shard long, no int, first long, n long")
        points = spark.range(0, n, 1, max(8, n // CHUNK_SLOTS // 4)).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n).cast("long")).alias("at"))
        ranges = self.sources.where("slots > 0").select("no", "first_slot", "slots")
        draws = self.scratch.keep(self.located(points, ranges, n).groupBy("shard", "no").agg(F.count("*").alias("drawn")))
        # running numbers of groups of shards, then within a group
        group = F.floor(F.col("shard") / SHARD_GROUP).alias("group")
        sums = self.scratch.keep(draws.groupBy("no", group).agg(F.sum("drawn").alias("words")))
        before = W.partitionBy("no").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
        starts = sums.select("no", "group", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("group_start"))
        inside = W.partitionBy("no", "group").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        at = draws.withColumn("group", group).withColumn("inner", F.coalesce(F.sum("drawn").over(inside), F.lit(0))).join(starts, ["no", "group"])
        # one row a source on the driver, as in `targets`
        total = {r.no: int(r.n) for r in sums.groupBy("no").agg(F.sum("words").alias("n")).collect()}
        over, short, given, wanted = [], [], 0, 0
        for no, slots in self.slots_of:
            gap = slots - total.get(no, 0)
            over.append((no, slots, given))
            given += max(-gap, 0)
            if gap > 0:
                short.append((no, wanted, gap, total.get(no, 0)))
                wanted += gap
        limits = spark.createDataFrame(over, "no int, slots long, given long").coalesce(1)
        at = at.join(F.broadcast(limits) if self.few else limits, "no").withColumn("start", F.col("group_start") + F.col("inner"))
        at = at.withColumn("own", F.greatest(F.lit(0).cast("long"), F.least("drawn", F.col("slots") - F.col("start"))))
        runs = at.where("own > 0").select("shard", "no", F.col("start").alias("first"), F.col("own").alias("n"))
        if short:
            free = at.where("own < drawn").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - F.col("own") - 1)).alias("k"), (F.col("given") + F.greatest(F.col("start") - F.col("slots"), F.lit(0))).alias("first"))
            open_ = spark.createDataFrame(short, "no int, first_slot long, slots long, drawn long").coalesce(1)
            filled = self.located(free.select("shard", (F.col("first") + F.col("k")).alias("at")), open_, wanted)
            runs = runs.union(filled.select("shard", "no", (F.col("drawn") + F.col("at") - F.col("first_slot")).alias("first"), F.lit(1).cast("long").alias("n")))
        return draws, self.scratch.keep(runs)

    def located(self, points: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
        """The range (first_slot, slots) of each point `at` of 0..n-1: both are laid out over cells and meet by an equi-join.

        There are at most CELLS cells, or four a range, so that a uniform point meets hardly more than one range on average, however many short ranges share a cell.
        """
        width = -(-n // max(CELLS, 4 * len(self.slots_of)))
        last = F.col("first_slot") + F.col("slots") - 1
        cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor(last / width))))
        met = points.withColumn("cell", F.floor(F.col("at") / width)).join(F.broadcast(cells) if self.few else cells, "cell")
        return met.where(F.col("at").between(F.col("first_slot"), last)).drop("cell")

    def counts(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        at = self.pieces.join(self.uses, ["no", "block"], "left").withColumn("words", F.coalesce(F.col("n") * F.col("uses"), F.lit(0)))
        sums = at.groupBy("no", "bucket", "row", "doc_id", "h", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
        return sums.select("doc_id", "size", "source_size", "target", "taken")

    def shards(self) -> DataFrame:
        """shard, no, drawn, slots: the multinomial count of a shard's slots on a source, and the slots it takes once totals are met."""
        taken = self.runs.groupBy("shard", "no").agg(F.sum("n").alias("slots"))
        return self.draws.join(taken, ["shard", "no"], "full").na.fill(0, ["drawn", "slots"])


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of every document.

    Each source's documents are laid end to end in a seeded order and cut into blocks of BLOCK words (the last may be shorter). A source's slots are
    its target in blocks. Each output shard draws how many of its slots every source gets, a multinomial count; what a source was drawn beyond its slots goes to those
    drawn too seldom (see `Mixture.drawn`). A slot's number within its source goes through the source's own permutation of block indexes,
    one whole pass before any block is used again, and joins the block by its index. No block is used more than twice.

    Null text: size 0, nothing taken. A null source is a source of its own, last. Rows that repeat doc_id are documents each. Extra columns are ignored. Reruns agree.
    """
    return Mixture(docs, seed).counts()


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as documents: for each document, one row for each pass over its source, text being the words taken in that pass; other columns as they are, n_chars counted anew."""
    m = Mixture(docs, seed)
    at = m.pieces.join(m.uses, ["no", "block"])
    used = at.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses")))).groupBy("no", "bucket", "row", "doc_id", "h", "use").agg(F.array_sort(F.collect_list(F.struct("from", "n"))).alias("parts"))
    # rows that repeat doc_id and text share a key, so their passes are counted together
    key = F.xxhash64("doc_id", "h")
    taken = used.select(key.alias("__k"), "row", "use", "parts", F.col("doc_id").alias("__id"))
    turn = F.row_number().over(W.partitionBy("__k", "use").orderBy("row"))
    taken = taken.withColumn("turn", turn)
    text = F.col("text").cast("string")
    own = docs.withColumn("__k", F.xxhash64(F.col("doc_id"), F.xxhash64(text)))
    own = own.withColumn("__turn", F.row_number().over(W.partitionBy("__k").orderBy(F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if c != "text"]))))
    joined = own.join(taken.withColumnRenamed("turn", "__turn"), ["__k", "__turn"])
    body = let(words(text), lambda ws: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(ws, (p["from"] + 1).cast("int"), p["n"].cast("int")))), " "))
    out = joined.withColumn("text", body)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
