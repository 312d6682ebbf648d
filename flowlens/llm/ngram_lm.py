"""Operator 7: interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the scoring tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, column_bytes, mix, small_batches, split_words
from .files import mapped, put

#: The word that ends a text: it holds a line break, so no word of a text equals it.
END = b"\n"
#: Entries of a file of the vocabulary, and training tokens behind a file of bigrams; both set how many files there are, not how large the model may be.
VOCABULARY_FILE, BIGRAM_FILE, BATCH_TOKENS = 2_000_000, 4_000_000, 2_000_000


def _hashes(b: pa.RecordBatch, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and end marks of all texts of a batch, and where each text begins."""
    ws = [[*split_words(t, lower=True), END] for t in column_bytes(b, "text")]
    starts = np.cumsum([0, *map(len, ws[:-1])]).astype(np.int64)
    return hashes.of([w for x in ws for w in x]), starts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, held, n = WordHashes(), [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])

    for b in small_batches(batches):
        held.append(_hashes(b, hashes)[0])
        n += len(held[-1])
        if n > BATCH_TOKENS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _write_sorted(folder: str, key: str, unsigned: bool):
    """Write the partition's (key, n) rows, which come sorted, as one file; yields (first, path, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [], []
        for b in batches:
            keys.append(b.column(key).to_numpy()), values.append(b.column("n").to_numpy())
        if keys and sum(map(len, keys)):
            k, v = np.concatenate(keys).astype(np.int64), np.concatenate(values).astype(np.int64)
            path = put(folder, k.tobytes() + v.tobytes(), ".bin")
            yield pa.RecordBatch.from_arrays([pa.array([int(k[0])]), pa.array([path]), pa.array([len(k)], pa.int64())], names=["first", "path", "size"])

    return run


class SortedFiles:
    """Sorted key arrays with a count each, in files that follow one another; looked up by binary search."""

    def __init__(self, files: list[tuple[int, str, int]]):
        files = sorted(files)
        self.firsts = np.array([f[0] for f in files], np.int64)
        self.offsets = np.cumsum([0, *(f[2] for f in files)])
        self.arrays = [(mapped(p, np.int64, n), mapped(p, np.int64, n, 8 * n)) for _, p, n in files]

    def __len__(self) -> int:
        return int(self.offsets[-1])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each (sorted) key among all keys, -1 if unknown, and its count, 0 if unknown."""
        place, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        cuts = np.r_[np.searchsorted(keys, self.firsts), len(keys)]
        for i, (k, v) in enumerate(self.arrays):
            part = keys[cuts[i] : cuts[i + 1]]
            if len(part):
                at = np.minimum(np.searchsorted(k, part), len(k) - 1)
                hit = k[at] == part
                place[cuts[i] : cuts[i + 1]] = np.where(hit, at + self.offsets[i], -1)
                count[cuts[i] : cuts[i + 1]] = np.where(hit, v[at], 0)
        return place, count


@lru_cache(maxsize=4)
def _open(files: tuple) -> SortedFiles:
    return SortedFiles(list(files))


def _ids(vocabulary: SortedFiles, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(h.view(np.int64), return_inverse=True)
    place, count = vocabulary.find(unique)
    return place[back], count[back]


def _previous(ids: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    before = np.r_[begin, ids[:-1]]
    before[starts] = begin
    return before


def _count_bigrams(vocabulary: tuple, begin: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, held, n = _open(vocabulary), WordHashes(), [], 0

        def flush():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            shard = shard_of(keys >> 32, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, keys[order[a:b]].tobytes(), c[order[a:b]].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "counts"])

        for b in small_batches(batches):
            h, starts = _hashes(b, hashes)
            ids, _ = _ids(known, h)
            held.append(_previous(ids, starts, begin) << 32 | ids)
            n += len(ids)
            if n > BATCH_TOKENS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return run


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    return (mix(context.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


_SHARD = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("contexts", pa.int64()), ("seen", pa.list_(pa.int64())), ("words", pa.binary()), ("before", pa.binary())])


def _write_shard(folder: str):
    """All bigrams of some contexts: file of sorted keys, counts, contexts and their sums; returns in how many contexts each word was seen."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        context = keys >> 32
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        path = put(folder, b"".join(x.tobytes() for x in (keys, counts, context[starts], *sums)), ".bin")
        words, before = np.unique(keys & 0xFFFFFFFF, return_counts=True)
        return pa.table({"shard": [key[0].as_py()], "path": [path], "size": [len(keys)], "contexts": [len(starts)], "seen": [[int((counts == k).sum()) for k in (1, 2, 3, 4)]], "words": [words.tobytes()], "before": [before.astype(np.int64).tobytes()]}, _SHARD)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w, n in zip(b.column("words").to_pylist(), b.column("before").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["v", "n"])


def discounts(seen: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many entries have counts 1 to 4; halves where these are too few."""
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


class Scorer:
    def __init__(self, spec: dict):
        self.vocabulary, self.words = _open(spec["vocabulary"]), _open(spec["words"])
        self.begin, self.shards, self.d, self.d_word = spec["begin"], spec["shards"], spec["d"], spec["d_word"]
        self.tokens, self.types, self.seen = spec["tokens"], spec["types"], spec["seen"]
        self.files = {}
        for s, path, n, m in spec["bigrams"]:
            at = [0, 8 * n, 16 * n, *(16 * n + 8 * m * k for k in range(1, 5))]
            self.files[s] = [mapped(path, np.int64, n, at[0]), mapped(path, np.int64, n, at[1]), *(mapped(path, np.int64, m, x) for x in at[2:])]

    def word_probability(self, ids: np.ndarray) -> np.ndarray:
        """Discounted share of the contexts that a word follows, interpolated with a uniform share for all words and one unknown."""
        unique, back = np.unique(ids, return_inverse=True)
        _, n = self.words.find(unique)
        used = self.d_word[np.minimum(n, 3)]
        total = max(self.types, 1)
        rest = float((self.d_word[1:] * self.seen).sum()) / total if self.types else 1.0
        return (np.maximum(n - used, 0) / total + rest / (len(self.vocabulary) + 1))[back]

    def score(self, h: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        ids, c = _ids(self.vocabulary, h)
        base = np.log10((c + 1.0) / (self.tokens + len(self.vocabulary) + 1.0))
        low = self.word_probability(ids)
        key, back = np.unique(_previous(ids, starts, self.begin) << 32 | np.where(ids < 0, 0xFFFFFFFF, ids), return_inverse=True)
        context = key >> 32
        shard = np.where(context < 0, -1, shard_of(context, self.shards))
        alpha, rest = np.zeros(len(key)), np.ones(len(key))
        for s in np.unique(shard):
            if s not in self.files:
                continue
            keys, counts, contexts, total, n1, n2, n3 = self.files[s]
            own = np.flatnonzero(shard == s)
            at = np.minimum(np.searchsorted(contexts, context[own]), len(contexts) - 1)
            hit = contexts[at] == context[own]
            own, at = own[hit], at[hit]
            t = total[at]
            rest[own] = (self.d[1] * n1[at] + self.d[2] * n2[at] + self.d[3] * n3[at]) / t
            place = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            n = np.where(keys[place] == key[own], counts[place], 0)
            alpha[own] = np.maximum(n - self.d[np.minimum(n, 3)], 0) / t
        total = np.log10(alpha[back] + rest[back] * low)
        add = lambda x: np.add.reduceat(x, starts)
        return {"n_tokens": np.diff(np.r_[starts, len(h)]), "n_known": add((c > 0).astype(np.int64)), "base_score": add(base), "score": add(total)}


@lru_cache(maxsize=1)
def _scorer(name: str, spec) -> Scorer:
    return Scorer(spec())


class _Spec:
    """The model's description, equal by name so that a worker opens it once."""

    def __init__(self, name: str, spec: dict):
        self.name, self.spec = name, spec

    def __call__(self) -> dict:
        return self.spec

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


def train(texts: DataFrame, scratch: Scratch) -> dict:
    """Count words, then bigrams of word ids, of a table with a text column. Files lie in the shared folder; the driver sees only their names and sums.

    Bigrams are dealt to shards by context; a hot context brings at most one entry for each word that follows it, counts being
    combined in each task before the shuffle. The number of shards follows the number of tokens.
    """
    folder = f"{scratch.root}/model"
    words = scratch.keep(texts.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, size = sums.n or 0, sums.v

    def files(df: DataFrame, key: str, entries: int) -> tuple:
        parts = max(1, -(-entries // VOCABULARY_FILE))
        listed = scratch.keep(df.repartitionByRange(parts, key).sortWithinPartitions(key).mapInArrow(_write_sorted(folder, key, False), "first long, path string, size long"))
        return tuple(sorted(tuple(r) for r in listed.collect()))

    vocabulary = files(words, "h", size)
    shards = max(1, -(-tokens // BIGRAM_FILE))
    packed = texts.select("text").mapInArrow(_count_bigrams(vocabulary, size, shards), "shard long, keys binary, counts binary")
    bigrams = scratch.keep(packed.groupBy("shard").applyInArrow(_write_shard(folder), "shard long, path string, size long, contexts long, seen array<long>, words binary, before binary"))
    after = scratch.keep(bigrams.select("words", "before").mapInArrow(_unpack, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")))
    listed = bigrams.select("shard", "path", "size", "contexts", "seen").collect()
    kinds = after.agg(F.sum("n").alias("n"), *(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count(F.when(F.col("n") >= 3, 1)).alias("more")).first()
    seen = [sum(r.seen[k] for r in listed) for k in range(4)]
    return {
        "vocabulary": vocabulary, "words": files(after, "v", size), "begin": size, "shards": shards, "tokens": tokens, "types": kinds.n or 0,
        "d": discounts(seen), "d_word": discounts([kinds.n1, kinds.n2, kinds.n3, kinds.n4]), "seen": np.array([kinds.n1, kinds.n2, kinds.more]),
        "bigrams": sorted((r.shard, r.path, r["size"], r.contexts) for r in listed),
    }


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; documents whose crc32(doc_id as text) mod folds is `held` are not learned from.

    Null text: empty, so its only token is the end mark. Null doc_id: crc32 is null, so the row is neither held out nor learned from. Repeated
    rows are learned from and scored each. Extra columns are ignored. No training rows: every word is unknown.
    """
    scratch = Scratch(docs.sparkSession, "ngram-lm")
    source = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"))
    model = _Spec(scratch.root, train(source.where(F.col("doc_id").isNotNull() & ~F.col("held_out")), scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, hashes = _scorer(model.name, model), WordHashes()
        for b in small_batches(batches):
            s = scorer.score(*_hashes(b, hashes))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()), pa.array([scorer.tokens] * b.num_rows, pa.int64()), pa.array(s["base_score"]), pa.array(s["score"])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
