"""Operator 13: spelling variants by composing the minimised vocabulary acceptor with a one-edit transducer and the acceptor again."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The letters of a word (fixed value).
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that one task composes from one initial state; a state with more is split (see `near_pairs`).
STATE_WORDS = 4000


def vocabulary(docs: DataFrame, least_chars: int = 6, least_count: int = 5, slip_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, of least_chars code points or more that occur least_count times or more.

    slip_every plants slips of the pen: where the crc32 h of `<doc_id>:<run>` is divisible by it, code point h % length of the run is left out (a null doc_id is written as nothing).
    Null and empty texts have no words. Occurrences are counted within tasks before they are shuffled, so that a frequent word costs a row a task.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.translate("run", _UPPER, _LOWER)
    runs = runs.where(F.char_length("run") >= least_chars).select("id", word.alias("word"))
    if slip_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.char_length("word")).cast("int")
        runs = runs.withColumn("word", F.when(F.col("h") % slip_every == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word")))
        runs = runs.where(F.char_length("word") >= least_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- automata, in a task


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct strings: arcs[state] maps a letter to a state; state 0 is initial."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""
        for s in [*strings, None]:
            shared = 0
            if s is not None:
                most = min(len(s), len(last))
                while shared < most and s[shared] == last[shared]:
                    shared += 1
            # what follows the shared part gets no more arcs: equal states become one
            for at in range(len(last), shared, -1):
                state = path.pop()
                same = known.setdefault((self.final[state], *self.arcs[state].items()), state)
                if same != state:
                    self.arcs[path[-1]][last[at - 1]] = same
            if s is None:
                break
            for c in s[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = s


def composed(a: Acceptor) -> Iterator[tuple[str, str]]:
    """Accepted pairs (u, v) of acceptor, one-edit transducer and acceptor, each once with u before v where one letter is replaced, and u the shorter where one is added.

    A state of the composition is (state of u, edit done, state of v). Until the edit both acceptors are in the same state; after it only equal letters are read, which is the intersection of two right languages.
    """
    shared: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """Strings that lead from both states to a final one."""
        if (found := shared.get((p, q))) is None:
            found, stack = [], [(p, q, "")]
            while stack:
                x, y, read = stack.pop()
                if a.final[x] and a.final[y]:
                    found.append(read)
                few, many = (a.arcs[x], a.arcs[y]) if len(a.arcs[x]) <= len(a.arcs[y]) else (a.arcs[y], a.arcs[x])
                for c in few:
                    if c in many:
                        stack.append((a.arcs[x][c], a.arcs[y][c], read + c))
            shared[p, q] = found
        return found

    stack = [(0, "")]
    while stack:
        state, read = stack.pop()
        arcs = list(a.arcs[state].items())
        added = set()
        for i, (c, p) in enumerate(arcs):
            for d, q in arcs[i + 1 :]:  # c replaced by d
                for rest in common(p, q):
                    yield read + c + rest, read + d + rest
            for rest in common(state, p):  # c added; within a run of equal letters every place gives the same pair
                if rest not in added and not (rest and rest[0] == c):
                    yield read + rest, read + c + rest
            stack.append((p, read + c))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            base = b.column("base")[row].as_py()
            members = {m["mid"]: (m["word"], m["n"]) for m in b.column("members")[row].as_py()}
            out = [(*members[u], *members[v]) for u, v in composed(Acceptor(sorted(members))) if len(u) == base]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64()) * 2, strict=True)], names=["a", "n_a", "b", "n_b"])


# ---------------------------------------------------------------- over all words


def _posted(words: DataFrame) -> DataFrame:
    """Two initial states for each row (word, n, pre, suf, mid, base): half of what is open goes to the shared prefix, or the rest of it to the shared suffix."""
    open_ = F.col("base")
    h = F.floor(open_ / 2).cast("int")
    s = open_ - h
    length = F.char_length("mid")
    by_prefix = F.struct(F.concat("pre", F.substring("mid", F.lit(1), h)).alias("pre"), F.col("suf"), F.substring("mid", h + 1, length).alias("mid"), (open_ - h).alias("base"))
    by_suffix = F.struct(F.col("pre"), F.concat(F.substring("mid", length - s + 1, s), F.col("suf")).alias("suf"), F.substring("mid", F.lit(1), length - s).alias("mid"), h.alias("base"))
    return words.select("word", "n", F.explode(F.array(by_prefix, by_suffix)).alias("x")).select("word", "n", "x.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (a, n_a, b, n_b) of rows (word, n) that differ by one inserted, deleted or replaced code point, each once.

    The work is divided by initial states of the composition. Two words at one edit whose shorter has L code points share the first floor(L/2) of them or the
    last L - floor(L/2); so the words are posted under both, once for L their length and once for one less, and the composition starts from the state that the shared
    prefix leads to (for suffixes: of the acceptor of what stands before them). `base` is what the shorter word has left. A state with more than STATE_WORDS
    words is split the same way, prefix or suffix growing by half of what is left, until it is small or at most two code points are left, of which an alphabet allows few.
    The rounds are logarithmic in the longest word. Each task holds the acceptor of one state at a time.
    """
    scratch = Scratch(words.sparkSession, "variants")
    length = F.char_length("word")
    start = words.select("word", "n", F.lit("").alias("pre"), F.lit("").alias("suf"), F.col("word").alias("mid"), F.explode(F.array(length, length - 1)).alias("base")).where("base > 0")
    keys, found = ["pre", "suf", "base"], []
    while True:
        posted = scratch.keep(_posted(start))
        sizes = scratch.keep(posted.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"))
        joined = posted.join(sizes, keys)
        small = joined.where((F.col("size") <= STATE_WORDS) | (F.col("base") <= 1))
        states = small.groupBy(*keys).agg(F.collect_list(F.struct("mid", "word", "n")).alias("members")).select("base", "members")
        found.append(scratch.keep(states.mapInArrow(_pairs, "a string, n_a long, b string, n_b long")))
        if sizes.where((F.col("size") > STATE_WORDS) & (F.col("base") > 1)).isEmpty():
            break
        start = scratch.keep(joined.where((F.col("size") > STATE_WORDS) & (F.col("base") > 1)).drop("size"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """One row for each row (word, n): word, n, n_near (near words, 0 if none), form (the near word of largest n, ties the smallest in code-point order, if its n >= times * the word's; else null), form_n, root (forms followed to the last; the word itself if it has none).

    Forms grow `times` fold at each step, so that roots are found by doubling in log2(log_times(largest n)) joins. A word has a bounded number of near words (places
    times letters), so that no group is large. An empty table gives no row; words are distinct by their making.
    """
    scratch = Scratch(words.sparkSession, "variant-groups")
    words = scratch.keep(words.select("word", "n"))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    w = words.join(best, "word", "left")
    formed = -F.col("best.m") >= times * F.col("n")
    w = scratch.keep(w.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")))
    roots = scratch.keep(w.where("form is not null").select("word", F.col("form").alias("root")))
    most = w.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(math.log(most, times), 1.0))) + 1):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = scratch.keep(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return w.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
