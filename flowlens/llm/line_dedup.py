"""Operator 2: fuzzy line deduplication with MinHash over character shingles, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound, let
from .graph import components

#: Characters of a shingle in the exact comparison, and the similarity from which two lines are the same.
SHINGLE, SIMILARITY = 5, 0.8
#: Lines of up to SHORT characters are signed by all their shingles; lines of more than LONG by a sample of longer shingles, of WIDE characters, those that start with a character of SAMPLED.
#: The sample depends on the content alone, whatever the script: it takes about one position in seven of text in Latin letters, digits and base64, and all of those beyond U+00FF.
#: Lines between are signed both ways, and so are longer lines whose sample holds fewer than FEW shingles, so that two similar lines share a kind.
SHORT, LONG, WIDE, FEW = 160, 128, 8, 16
SAMPLED = "[ndlgyCKQWX39/\\u0100-\\x{10FFFF}]"
#: Band keys: each two of the 5 smallest hashes of a sample, each three of the 5 smallest of all shingles (short lines share their most frequent shingles with many others).
BANDS = {"sample": (5, 2), "every": (5, 3)}
#: The KEPT smallest hashes set bits in two words of 64, about half of them, so that unlike lines share 0.3 of their bits as well. A pair is compared in full if it has at least LIKELY
#: of its bits in common: that of similarity 0.54 for all shingles, four deviations below 0.8, and of 0.37 for samples, whose longer shingles agree in about 0.7 at similarity 0.8.
KEPT, LIKELY_EVERY, LIKELY_SAMPLE = 40, 0.68, 0.56
#: Of lists of up to WHOLE lines all pairs are made in the first round, each list in one row; only longer lists go on.
WHOLE = 64
#: Longs of 64 bits in a parity map of a full shingle set. Maps of unlike lines differ in too many bits for similarity 0.8 up to about 2000 shingles; longer ones are told apart by the exact test alone.
PARITY_WORDS = 16
#: Lines to fetch are sent to all tasks up to so many hashes (8 bytes each), else both sides are shuffled.
BROADCAST_LINES = 500_000


def _hashes(parts: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(parts, lambda s: F.hash(s))))


def _bits(hashes: Column, skip: int) -> Column:
    """A bit for each of the smallest hashes, by 6 of its own bits (a shift of a long takes the lowest 6)."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.slice(hashes, 1, KEPT), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(x, skip) if skip else x)))


def _parts(line: Column) -> Column:
    """Character shingles of a line; a line shorter than one is a shingle itself."""
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1)))


def signed(lines: DataFrame) -> DataFrame:
    """lines (with a column line) and, for each kind of signature, the smallest hashes, two words of bits and the number of shingles; null where the line does not use the kind.

    What several columns need is bound first, so that it is computed once.
    """
    length = F.length("line")
    sample = F.when(length > LONG, F.regexp_extract_all("line", F.lit(f"(?s)(?=({SAMPLED}.{{{WIDE - 1}}}))"), F.lit(1)))
    at = bound(lines, sample=_hashes(sample))
    whole = (length <= SHORT) | (F.size("sample") < FEW)
    at = bound(at, every=F.when(whole, _hashes(_parts(F.col("line"))))).withColumn("sample", F.when(F.size("sample") >= BANDS["sample"][1], F.col("sample")))
    cols = [c for kind, (most, _) in BANDS.items() for c in (F.slice(kind, 1, most).alias(f"{kind}_low"), _bits(F.col(kind), 0).alias(f"{kind}_m0"), _bits(F.col(kind), 6).alias(f"{kind}_m1"), F.when(F.col(kind).isNotNull(), F.size(kind)).alias(f"{kind}_n"))]
    return at.select(*lines.columns, *cols)


def band_keys(low: Column, kind: str) -> Column:
    """Array of a key for each choice of the smallest hashes, null where one is missing; the first is of all hashes for lines that have fewer than a choice takes."""
    most, take = BANDS[kind]
    seed, size = F.lit(kind), F.size(low)
    keys = [F.when(size > c[-1], F.xxhash64(*[F.get(low, F.lit(i)) for i in c], seed)) for c in combinations(range(most), take)]
    keys[0] = F.when(size < take, F.xxhash64(low, seed)).otherwise(keys[0])
    return F.array(*keys)


def shingles(line: Column) -> Column:
    """Distinct 64-bit hashes of the character shingles of a line."""
    return F.array_distinct(F.transform(_parts(line), lambda s: F.xxhash64(s)))


def similar(x: Column, y: Column) -> Column:
    """Exact test on two shingle sets; sets whose sizes differ too much are not compared."""
    sizes = F.size(x) + F.size(y)
    return F.when(F.least(F.size(x), F.size(y)) < SIMILARITY * F.greatest(F.size(x), F.size(y)), F.lit(False)).otherwise((1 + SIMILARITY) * F.size(F.array_intersect(x, y)) >= SIMILARITY * sizes)


def parities(lines: DataFrame) -> DataFrame:
    """(h, size, p0, ...) of lines (h, line): the number of shingles and, for each bucket of their hashes, whether it holds an odd number of them."""
    sets = bound(lines.select("h", "line"), set=shingles(F.col("line")))
    one = F.lit(1).cast("long")

    def odd(i: int) -> Column:
        own = F.filter("set", lambda z: F.shiftright(z, 6).bitwiseAND(F.lit(PARITY_WORDS - 1)) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, z: acc.bitwiseXOR(F.call_function("shiftleft", one, z.bitwiseAND(F.lit(63)).cast("int"))))

    return sets.select("h", F.size("set").alias("size"), *[odd(i).alias(f"p{i}") for i in range(PARITY_WORDS)])


def _close(a: str, b: str) -> Column:
    """Whether parity maps and sizes allow similarity 0.8. No link is lost: two sets differ in at least as many shingles as their maps differ in bits."""
    low, high, flipped = F.least(f"size_{a}", f"size_{b}"), F.greatest(f"size_{a}", f"size_{b}"), F.lit(0)
    for i in range(PARITY_WORDS):
        flipped = flipped + F.bit_count(F.col(f"p{i}_{a}").bitwiseXOR(F.col(f"p{i}_{b}")))
    return (low >= SIMILARITY * high) & ((1 + SIMILARITY) * flipped <= (1 - SIMILARITY) * (low + high) + 0.001)


def _likely(a: str, b: str) -> Column:
    """Whether the signatures of two members of a list allow similarity 0.8: sizes (with four deviations of room, since they may be those of samples) and shared bits."""
    low, high = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")
    words = [(F.col(f"m{i}_{a}"), F.col(f"m{i}_{b}")) for i in range(2)]
    shared = sum((F.bit_count(x.bitwiseAND(y)) for x, y in words[1:]), F.bit_count(words[0][0].bitwiseAND(words[0][1])))
    either = sum((F.bit_count(x.bitwiseOR(y)) for x, y in words[1:]), F.bit_count(words[0][0].bitwiseOR(words[0][1])))
    return (low + 1.8 * F.sqrt(high) >= SIMILARITY * high) & (shared >= F.when(F.col(f"every_{a}"), LIKELY_EVERY).otherwise(LIKELY_SAMPLE) * either)


def document_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("/"), F.col("text").cast("string"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a visible character: document key, doc_id, place, text, its hash and its signatures."""
    # the key is made before the lines are taken apart, so that it is made once for a document
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("k"), F.split(F.col("text").cast("string"), "\n").alias("parts"))
    lines = keyed.select("doc_id", "k", F.posexplode("parts").alias("place", "line")).where(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    return signed(lines.withColumn("h", F.xxhash64("line")))


class _Job:
    """State of one run: the lines, the links found so far and the texts fetched for them."""

    def __init__(self, docs: DataFrame):
        self.scratch = Scratch(docs.sparkSession, "line-dedup")
        self.lines = self.scratch.keep(_occurrences(docs))
        self.links: DataFrame | None = None
        self.n_links = 0
        self.labels: DataFrame | None = None
        self.texts: DataFrame | None = None
        self.tested: DataFrame | None = None

    def posted(self) -> DataFrame:
        """(key, h, m0, m1, n, every) of each line in each list that holds two different lines or more."""
        # only names of lines go through the two shuffles of all postings; bits and sizes are looked up for what is left
        kinds = [self.lines.where(F.col(f"{kind}_n").isNotNull()).select("h", F.explode(band_keys(F.col(f"{kind}_low"), kind)).alias("key"), F.lit(kind == "every").alias("every")) for kind in BANDS]
        rows = kinds[0].union(kinds[1]).where("key is not null")
        # lists of one line cannot link anything; the bounds are combined before the shuffle
        lists = rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
        # a table of its own on either side of the join lets Spark split a hot key
        lists = self.scratch.keep(lists)
        self.scratch.only(lists, *self.held())
        found = self.scratch.keep(rows.join(lists.hint("shuffle_hash"), "key").groupBy("key", "h").agg(F.max("every").alias("every")))
        self.scratch.only(found, *self.held())
        signs = [f"{kind}_{c}" for kind in BANDS for c in ("m0", "m1", "n")]
        signs = self.lines.groupBy("h").agg(*[F.max(c).alias(c) for c in signs])
        both = found.join(signs, "h")
        out = self.scratch.keep(both.select("key", "h", *[F.when(F.col("every"), F.col(f"every_{c}")).otherwise(F.col(f"sample_{c}")).alias(c) for c in ("m0", "m1", "n")], "every"))
        self.scratch.only(out, *self.held())
        return out

    def with_component(self, df: DataFrame) -> DataFrame:
        if self.labels is None:
            return df.withColumn("comp", F.col("h"))
        return df.join(self.labels.select(F.col("node").alias("h"), "label"), "h", "left").withColumn("comp", F.coalesce("label", "h")).drop("label")

    def open_lists(self, members: DataFrame) -> DataFrame:
        """Members, with their components, of lists that still hold two components or more."""
        at = self.scratch.keep(self.with_component(members))
        lists = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        out = self.scratch.keep(at.join(self.scratch.keep(lists), "key"))
        self.scratch.drop(at)
        return out

    def within(self, members: DataFrame, lists: DataFrame) -> DataFrame:
        """Likely pairs of all members of the given lists (key), which are short."""
        lines = members.join(lists, "key").groupBy("key").agg(F.collect_list(F.struct("h", "m0", "m1", "n", "every")).alias("x")).select("x")
        both = lines.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a.h < b.h")
        return both.select(*[F.col(f"{e}.{c}").alias(f"{c}_{e}") for e in "ab" for c in ("h", "m0", "m1", "n", "every")]).where(_likely("a", "b")).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))

    def leaders(self, members: DataFrame) -> DataFrame:
        """(key, leader): the first and the last member of each list, and the first one in an order of the list's own."""
        line = F.struct("h", "m0", "m1", "n", "every")
        ends = F.array(F.min(line), F.max(line), F.min_by(line, F.col("h").bitwiseXOR(F.xxhash64("key"))))
        return self.scratch.keep(members.groupBy("key").agg(ends.alias("ends"))).select("key", F.explode(F.array_distinct("ends")).alias("leader"))

    def led(self, members: DataFrame, leaders: DataFrame) -> DataFrame:
        """Likely pairs of each member with the leaders (key, leader) of its list."""
        cols = ("h", "m0", "m1", "n", "every")
        first = leaders.select("key", *[F.col(f"leader.{c}").alias(f"{c}_b") for c in cols])
        both = members.select("key", *[F.col(c).alias(f"{c}_a") for c in cols]).join(first, "key")
        return both.where((F.col("h_a") != F.col("h_b")) & _likely("a", "b")).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))

    def across(self, members: DataFrame) -> DataFrame:
        """Pairs of members of different components of a list, one of them outside its largest component, whose full sets may be similar, in lists of any length.

        A pair is made in the first list that it shares only. Semi joins find the members that have a likely partner at all; parity maps of the full shingle sets of these
        are compared within the join, so that hardly more rows leave it than there are links. Both sides are tables, so that Spark splits a long list.
        """
        main = members.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"))
        own = members.groupBy("h").agg(F.collect_set("key").alias("keys"))  # a line has 20 keys at most
        every = self.scratch.keep(members.join(own, "h"))
        outside = self.scratch.keep(every.join(main, "key").where("comp <> main").drop("main"))

        def side(df: DataFrame, e: str) -> DataFrame:
            return df.select(*[F.col(c).alias(f"{c}_{e}") for c in df.columns])

        first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a")
        pair = (F.col("key_a") == F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & _likely("a", "b")
        x = self.scratch.keep(side(outside, "a").join(side(every, "b"), pair, "left_semi"))
        y = self.scratch.keep(side(every, "b").join(x, pair, "left_semi"))
        self.scratch.only(x, y, *self.held())
        wanted = self.scratch.keep(x.select(F.col("h_a").alias("h")).union(y.select("h_b")).distinct())
        self.fetch(wanted.select(F.col("h").alias("a"), F.col("h").alias("b")))
        maps = self.scratch.keep(parities(self.texts.join(wanted, "h", "left_semi")))
        x, y = (self.scratch.keep(df.join(side(maps, e), f"h_{e}")) for df, e in ((x, "a"), (y, "b")))
        self.scratch.only(x, y, *self.held())
        return x.join(y, pair & _close("a", "b") & first).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))

    def fetch(self, pairs: DataFrame) -> None:
        """Add the texts of lines in pairs that are not fetched yet."""
        need = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
        need = self.scratch.keep(need if self.texts is None else need.join(self.texts.select("h"), "h", "left_anti"))
        size = need.count()
        few = size <= BROADCAST_LINES
        found = self.lines.select("h", "line").join(F.broadcast(need) if few else need.hint("shuffle_hash"), "h", "left_semi").dropDuplicates(["h"])
        found = self.scratch.keep(found, size, 10_000)
        self.texts = found if self.texts is None else self.texts.union(found)

    def link(self, pairs: DataFrame) -> None:
        """Confirm pairs on full shingle sets and join components."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = self.scratch.keep(pairs if self.tested is None else pairs.join(self.tested, ["a", "b"], "left_anti"))
        size = pairs.count()
        if not size:
            return
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        self.fetch(pairs)
        both = pairs.join(self.texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b").join(self.texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
        sets = bound(both.select("a", "b", "x", "y"), s=shingles(F.col("x")), t=shingles(F.col("y")))
        sure = self.scratch.keep(sets.where(similar(F.col("s"), F.col("t"))).select("a", "b"), size)
        if linked := sure.count():
            self.n_links += linked
            self.links = sure if self.links is None else self.links.union(sure)
            self.labels = components(self.links, self.scratch, self.n_links)

    def settle(self, pairs: DataFrame, members: DataFrame) -> None:
        """Confirm each line with its first partner, then those pairs that are still of different components. members are kept for later rounds."""
        pairs = self.scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        self.scratch.only(pairs, members, *self.held())
        self.link(pairs.groupBy("b").agg(F.min("a").alias("a")))
        self.scratch.only(pairs, members, *self.held())
        ends = self.with_component(pairs.withColumnRenamed("a", "h")).select(F.col("h").alias("a"), F.col("b").alias("h"), F.col("comp").alias("comp_a"))
        self.link(self.with_component(ends).where("comp <> comp_a").select("a", F.col("h").alias("b")))

    def held(self) -> list[DataFrame]:
        """What later rounds read."""
        return [t for t in (self.lines, self.links, self.labels, self.texts, self.tested) if t is not None]

    def run(self) -> DataFrame:
        """(h, first) for each line: the first occurrence of its component."""
        members = self.posted()
        sizes = self.scratch.keep(members.groupBy("key").agg((F.count("*") > WHOLE).alias("long")))
        self.scratch.only(sizes, members, *self.held())
        pairs = self.scratch.keep(self.within(members, sizes.where("not long").select("key")))
        self.scratch.only(pairs, sizes, members, *self.held())
        members = self.scratch.keep(members.join(sizes.where("long").select("key"), "key"))
        self.scratch.only(pairs, members, *self.held())
        self.settle(pairs.union(self.led(members, self.leaders(members))), members)
        self.scratch.only(members, *self.held())
        members = self.open_lists(members)
        if not members.isEmpty():
            self.scratch.only(members, *self.held())
            self.link(self.across(members))
        self.scratch.only(*self.held())
        classes = self.scratch.keep(self.lines.groupBy("h").agg(F.min(F.struct("doc_id", "place", "k")).alias("first")))
        if self.labels is None:
            return classes
        # only lines with links have to look for the first line of others
        named = self.scratch.keep(classes.join(self.labels.select(F.col("node").alias("h"), "label"), "h"))
        roots = named.groupBy("label").agg(F.min("first").alias("root"))
        moved = self.scratch.keep(named.select("h", "label").join(roots, "label").select("h", "root"))
        return self.scratch.keep(classes.join(moved, "h", "left").select("h", F.coalesce("root", "first").alias("first")))


def _marked(docs: DataFrame) -> DataFrame:
    """(k, n_lines, dropped) for each document with a visible line."""
    job = _Job(docs)
    leading = job.run()
    places = job.scratch.keep(job.lines.select("k", "place", "h"))
    job.scratch.only(places, leading)
    marked = places.join(leading, "h")
    repeated = (F.col("first.k") != F.col("k")) | (F.col("first.place") != F.col("place"))
    places = F.array_sort(F.collect_set(F.when(repeated, F.col("place"))))
    return marked.groupBy("k").agg(F.size(F.collect_set("place")).cast("long").alias("n_lines"), places.alias("dropped"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(k, doc_id, n_lines, dropped): for each row of docs, how many visible lines it has and the sorted places (from 0) of those that repeat.

    Lines are split at \\n. Equal lines form a class. Classes that share a band key form a list. All pairs of short lists are made; in longer ones each class is paired with
    the first and the last one and with a leader in an order of the list's own. Pairs whose signatures allow it are confirmed by the exact Jaccard similarity of their shingle sets (SIMILARITY or more), and
    components are joined. Long lists that still hold several components are paired across them, at any length. Of each component the first line by (doc_id, place) stays.

    Null and blank texts have 0 lines and nothing to drop; blank lines are never dropped. A null doc_id comes first. Rows that repeat both doc_id and text are one
    document: each gets the same result. Of equal lines at the same (doc_id, place) one stays. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = docs.select(document_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"))
    found = rows.join(_marked(docs), "k", "left")
    return found.select("k", "doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text, its other columns as they are (n_chars, where there is one, is counted anew); documents in which no visible line is left, and had one, go.

    Rows without a visible line (null and blank texts) stay as they are. Ties, repeated rows and clashing columns are treated as in duplicate_lines.
    """
    found = _marked(docs).where(F.size("dropped") > 0).select(F.col("k").alias("__k"), F.col("n_lines").alias("__n"), F.col("dropped").alias("__d"))
    joined = docs.withColumn("__k", document_key()).join(found, "__k", "left")
    joined = joined.where(F.col("__d").isNull() | (F.size("__d") < F.col("__n")))
    parts = F.split(F.col("text").cast("string"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__d"))
    text = F.when(F.col("__d").isNull(), F.col("text")).otherwise(let(parts, lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n")))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
