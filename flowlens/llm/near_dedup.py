"""Operator 1: near-duplicate documents by an inverted join on MinHash signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, column_bytes, mix, small_batches, split_words
from .graph import components

#: Signature coordinates; so many standard deviations below the mean of a pair at the threshold may its agreeing coordinates lie (40 of 64 at similarity 0.85, 35 at 0.8).
COORDINATES, DEVIATIONS = 64, 5
#: Bits of a parity map of a full set: two sets differ in at least as many shingles as their maps differ in bits, so no link is lost by it.
PARITIES = 512
#: Lists that still hold several components after two leader rounds are posted anew under BANDS bands of BAND_WIDTH coordinates: a pair at similarity 0.85 shares none with probability 0.0003, one at 0.9 in none of 40,000 trials (drawn at random, these bands).
#: Members meet a leader there in BAND_ROUNDS round; then those outside a list's largest component meet every member of another component, in lists of any length.
#: BAND_WIDTH is that at similarity 0.85; at others a band is as likely to be shared (5 coordinates at 0.8).
BANDS, BAND_WIDTH, BAND_ROUNDS = 48, 7, 1
#: Lists that a pair must share with the same leader in the first round; the later rounds take pairs that share fewer.
COLLISIONS = 2
#: Needed texts are picked by a broadcast list only up to so many ids (8 bytes each).
BROADCAST_IDS = 100_000

_ORDERS = np.random.default_rng(7).permuted(np.tile(np.arange(COORDINATES), (BANDS, 1)), axis=1)
_FACTORS = np.random.default_rng(20240601).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def limits(percent: int) -> tuple[int, int, int]:
    """How many coordinates must agree before full sets are compared, how many are posted (a pair that agrees in so many agrees in one of any of the rest and one more), and the band width."""
    p = percent / 100
    matches = max(1, math.floor(COORDINATES * p - DEVIATIONS * math.sqrt(COORDINATES * p * (1 - p))))
    width = BAND_WIDTH if percent >= 85 else max(1, math.floor(BAND_WIDTH * math.log(0.85) / math.log(p)))
    return matches, COORDINATES - matches + 1, width


def shingles(text: bytes | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; one for the whole sequence if it is shorter than size; none without words."""
    ws = split_words(text, lower=True)
    if not ws:
        return np.empty(0, np.uint64)
    h, width = hashes.of(ws), min(size, len(ws))
    n = len(ws) - width + 1
    out = mix(h[:n] + np.uint64(width))
    for k in range(1, width):
        out = mix(out + h[k : k + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest value of each of COORDINATES permutations of the 64-bit hashes."""
    best = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(s), 2048):
        np.minimum(best, np.multiply.outer(_FACTORS, s[at : at + 2048]).min(axis=1), out=best)
    return best


def parities(s: np.ndarray) -> np.ndarray:
    """For each of PARITIES buckets of the hashes, whether it holds an odd number of them; 64 a long."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8")


def _signed(posted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in small_batches(batches):
            n, cls, prefix, sketch, odd = [], [], [], [], []  # of each text
            for text in column_bytes(b, "text"):
                s = shingles(text, hashes)
                n.append(len(s))
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                sig = signature(s) if len(s) else None
                prefix.append(None if sig is None else sig[:posted].view(np.int64))
                sketch.append(None if sig is None else (mix(sig) >> np.uint64(56)).astype(np.uint8).view("<i8"))
                odd.append(None if sig is None else parities(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), *[pa.array(x, pa.list_(pa.int64())) for x in (sketch, odd)]], names=["doc_id", "text_key", "n_shingles", "cls", "prefix", "sketch", "odd"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for b in small_batches(batches, 64):
            a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
            keep = []
            for x, ta, tb in zip(a, column_bytes(b, "text_a"), column_bytes(b, "text_b"), strict=True):
                if last[0] != x:
                    last = (x, shingles(ta, hashes))
                sa, sb = last[1], shingles(tb, hashes)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * common >= percent * (len(sa) + len(sb) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(mask), pa.array(c, pa.int64()).filter(mask)], names=["a", "b"])

    return run


def agreement(x: str, y: str) -> Column:
    """In how many coordinates two sketches agree. A sketch holds a byte a coordinate, eight in a long; no lambda, so that joins compile it."""
    differing = F.lit(0)
    for i in range(COORDINATES // 8):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        for shift in (4, 2, 1):  # the lowest bit of each byte becomes the union of its bits
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        differing = differing + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(COORDINATES) - differing


def likely(a: str, b: str, percent: int, matches: int) -> Column:
    """Whether sketch, parity map and set size of classes a and b (suffixes of the columns) allow a link: `matches` coordinates agree, and the sets need not differ in too many shingles."""
    flipped = F.lit(0)
    for i in range(PARITIES // 64):
        flipped = flipped + F.bit_count(F.get(f"odd_{a}", F.lit(i)).bitwiseXOR(F.get(f"odd_{b}", F.lit(i))))
    sizes = F.col(f"n_shingles_{a}") + F.col(f"n_shingles_{b}")
    return ((100 + percent) * flipped <= (100 - percent) * sizes) & (agreement(f"sketch_{a}", f"sketch_{b}") >= matches)


EVIDENCE = ("n_shingles", "sketch", "odd")


def coordinate(sketch: str, k: int) -> Column:
    """The byte of coordinate k."""
    return F.shiftright(F.get(sketch, F.lit(k // 8)), 8 * (k % 8)).bitwiseAND(F.lit(255))


class _Job:
    """State of one run: classes of equal shingle sets, their labels, and the links found so far."""

    def __init__(self, docs: DataFrame, percent: int):
        self.spark, self.percent = docs.sparkSession, percent
        self.matches, self.posted, self.width = limits(percent)
        self.scratch = Scratch(self.spark, "near-dedup")
        self.source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
        self.docs = self.scratch.keep(self.source.mapInArrow(_signed(self.posted), "doc_id long, text_key long, n_shingles long, cls long, prefix array<long>, sketch array<long>, odd array<long>"))
        known = self.docs.where("cls is not null")
        # equal sets have equal signatures
        self.classes = self.sigs = self.scratch.keep(known.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n_shingles", "prefix", "sketch", "odd")]))
        self.n_links = 0
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.texts: DataFrame | None = None
        self.tested: DataFrame | None = None

    def with_component(self, df: DataFrame) -> DataFrame:
        if self.labels is None:
            return df.withColumn("comp", F.col("cls"))
        return df.join(self.labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label")

    def open_lists(self, postings: DataFrame, order) -> DataFrame:
        """Posting lists that still hold several components: (key, cls, comp, leader, size). The leader is the first class in an order given by xor with `order`."""
        lists = postings.groupBy("key").agg(F.min(F.col("cls").bitwiseXOR(order)).bitwiseXOR(order).alias("leader"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
        # a table of its own on either side of the join lets Spark split a hot key
        return postings.join(self.scratch.keep(lists.where("low <> high").drop("low", "high")), "key")

    def across(self, opened: DataFrame) -> DataFrame:
        """Links between members of different components of a list, one of them outside its largest component, in lists of any length.

        A pair is made in the first list that it shares only. Semi joins find the members that have a likely partner at all (see `likely`); the full shingle sets of these are compared within the join, so that no more rows leave it than there are links.
        Both sides are tables, so that Spark splits a long list.
        """
        main = opened.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
        # a class is in at most BANDS lists
        own = opened.groupBy("cls").agg(F.collect_set("key").alias("keys")).join(self.sigs.select("cls", *EVIDENCE), "cls")
        every = self.scratch.keep(opened.select("key", "cls", "comp").join(self.scratch.keep(own), "cls"))
        outside = self.scratch.keep(every.join(self.scratch.keep(main), "key").where("comp <> main").drop("main"))

        def side(df: DataFrame, e: str) -> DataFrame:
            return df.select(*[F.col(c).alias(f"{c}_{e}") for c in df.columns])

        first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a")
        pair = (F.col("key_a") == F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & likely("a", "b", self.percent, self.matches)
        x = self.scratch.keep(side(outside, "a").join(side(every, "b"), pair, "left_semi"))
        if x.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        y = self.scratch.keep(side(every, "b").join(x, pair, "left_semi"))
        texts = self.fetch(x.select(F.col("cls_a").alias("a"), F.col("cls_a").alias("b")).union(y.select("cls_b", "cls_b")))
        wanted = x.select(F.col("cls_a").alias("cls")).union(y.select("cls_b")).distinct()
        sets = self.scratch.keep(texts.join(wanted, "cls", "left_semi").mapInArrow(_sets, "cls long, set array<long>"))
        x, y = (self.scratch.keep(df.join(side(sets, e), f"cls_{e}")) for df, e in ((x, "a"), (y, "b")))
        sizes = F.size("set_a") + F.size("set_b")
        common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        near = (100 * F.least(F.size("set_a"), F.size("set_b")) >= self.percent * F.greatest(F.size("set_a"), F.size("set_b"))) & ((100 + self.percent) * common >= self.percent * sizes)
        return x.join(y, pair & first & near).select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()

    def link(self, pairs: DataFrame, collisions: int = 1) -> bool:
        """Count agreeing coordinates of the pairs (a, b), confirm those above the threshold on full sets, and join components. Whether any pair was confirmed now."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= collisions).drop("n")
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        sides = [self.sigs.select(F.col("cls").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in EVIDENCE]) for e in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b")
        found = self.scratch.keep(both.where(likely("a", "b", self.percent, self.matches)).select("a", "b"))
        size = found.count()
        if not size:
            return False
        self.tested = found if self.tested is None else self.tested.union(found)
        texts = self.fetch(found)
        full = found.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
        return self.joined(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(self.percent), "a long, b long"), size)

    def joined(self, sure: DataFrame, rows: int | None = None) -> bool:
        """Add confirmed links and join components anew. Whether there were any."""
        sure = self.scratch.keep(sure, rows)
        size = sure.count()
        if not size:
            return False
        self.n_links += size
        self.links = sure if self.links is None else self.links.union(sure)
        self.labels = components(self.links, self.scratch, self.n_links)
        return True

    def fetch(self, pairs: DataFrame) -> DataFrame:
        """Texts of the classes in pairs, by class; one document stands for each. Texts fetched before are reused."""
        need = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        if self.texts is not None:
            need = need.join(self.texts.select("cls"), "cls", "left_anti")
        need = self.scratch.keep(need.join(self.classes.select("cls", "text_key"), "cls"))
        count = need.count()
        if count:
            keys = need.select("text_key")
            picked = self.source.select("text_key", "text").join(F.broadcast(keys) if count <= BROADCAST_IDS else keys, "text_key", "left_semi").dropDuplicates(["text_key"])
            found = self.scratch.keep(picked.join(need, "text_key").select("cls", "text"), count, 2_000)
            self.texts = found if self.texts is None else self.texts.union(found)
        return self.spark.createDataFrame([], "cls long, text string") if self.texts is None else self.texts

    def run(self) -> DataFrame:
        postings = self.sigs.select("cls", F.posexplode("prefix").alias("pos", "value")).select("cls", F.xxhash64("pos", "value").alias("key"))
        # lists of one class cannot link anything and go first; the counts are combined before the shuffle
        lists = postings.groupBy("key").agg(F.count("*").alias("size"))
        postings = self.scratch.keep(postings.join(self.scratch.keep(lists.where("size > 1").drop("size")), "key"))
        opened = self.open_lists(self.with_component(postings), F.lit(0).cast("long"))
        self.link(opened.select(F.col("leader").alias("a"), F.col("cls").alias("b")), COLLISIONS)
        opened = self.scratch.keep(self.open_lists(self.with_component(postings), F.xxhash64("key")))
        self.link(opened.select(F.col("leader").alias("a"), F.col("cls").alias("b")))
        left = self.with_component(opened.select("cls", "key")).groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        left = opened.select("cls", "key").join(self.scratch.keep(left), "key").select("cls").distinct().join(self.sigs.select("cls", "sketch"), "cls")
        bands = F.array(*[F.xxhash64(F.lit(i), *[coordinate("sketch", k) for k in places]) for i, places in enumerate(_ORDERS[:, : self.width].tolist())])
        postings = left.select("cls", F.explode(bands).alias("key"))
        lists = self.scratch.keep(postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").drop("size"))
        postings = self.scratch.keep(postings.join(lists, "key"))
        for r in range(BAND_ROUNDS):
            opened = self.scratch.keep(self.open_lists(self.with_component(postings), F.xxhash64("key", F.lit(r))))
            if opened.isEmpty():
                break
            self.link(opened.select(F.col("leader").alias("a"), F.col("cls").alias("b")))
            if r == BAND_ROUNDS - 1:
                opened = self.scratch.keep(self.open_lists(self.with_component(opened.select("cls", "key")), F.xxhash64("key")))
                self.joined(self.across(opened))
            postings = opened.select("cls", "key")
        return self.result()

    def result(self) -> DataFrame:
        smallest = self.with_component(self.classes)
        if self.labels is not None:
            roots = self.scratch.keep(smallest.groupBy("comp").agg(F.min("first_id").alias("component_id")))
            smallest = smallest.join(roots, "comp")
        else:
            smallest = smallest.withColumn("component_id", F.col("first_id"))
        found = self.scratch.keep(smallest.select("cls", "component_id"))
        out = self.docs.select("doc_id", "n_shingles", "cls").join(found, "cls", "left")
        component = F.coalesce("component_id", "doc_id")
        out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
        self.scratch.only(out)
        return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in small_batches(batches):
        sets = [shingles(t, hashes).view(np.int64) for t in column_bytes(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "set"])


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Documents with equal shingle sets form a class; a class is posted under each of its first `posted` coordinate values.
    Members of a list are first paired with the list's leader only, agreeing coordinates are counted (the ones not posted
    are skipped in the merge and compared from the sketch), pairs with `matches` of them (see `limits`) are confirmed on full sets, and
    components are joined. Lists that then hold one component are done, so a large group of copies costs a number of
    pairs in proportion to its size. A second round gives every list a leader of its own. Classes in lists that still hold
    several components are posted under bands of coordinates, where members meet leaders again and then those outside a list's largest
    component meet every member of another component, in lists of any length. A link can be missed only where the two share no band or agree
    in fewer than `matches` coordinates; confirmed links are exact.

    Null or blank text: n_shingles 0, its own component, kept. Null doc_id: such a row can link others but is never kept
    unless no other row shares its component (then component_id is null and kept false). Repeated rows: each gets the same result. Extra columns are ignored.
    """
    return _Job(docs, percent).run()
