"""Operator 10: language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, mix, small_batches

#: Length of the character n-grams.
ORDER = 4
#: Labelled documents of each language, chosen by a hash of doc_id: a bounded sample. Every CALIBRATION_SHARE-th calibrates rejection, the others are fitted on.
SAMPLE_ROWS, CALIBRATION_SHARE = 500, 4
#: Bits a letter beyond the worst calibration document, and letters a text must have, before a text counts as no known language.
MARGIN_BITS, LEAST_LETTERS = 0.75, 40
#: Letters whose evidence is counted in full for the score.
SCORE_LETTERS = 24
#: Sampled ids are joined by broadcast up to so many.
BROADCAST_IDS = 100_000


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for all that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            table[c] = ord(s.lower()[0])
    return table


def letters(text: str | None) -> np.ndarray:
    """Lower-case letters with one space for each run of others; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    c = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    c = np.r_[np.uint32(32), c, np.uint32(32)]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    return c if len(c) > 2 else np.empty(0, np.uint32)


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that start at each place, for n = 0 to ORDER; those of length n are defined up to place len(c) - n."""
    out = [np.zeros(len(c) + 1, np.uint64)]
    for n in range(1, ORDER + 1):
        out.append(mix(out[-1][: len(c) - n + 1] * np.uint64(31) + c[n - 1 :].astype(np.uint64) + np.uint64(n << 32)))
    return out


class Model:
    """For each n: sorted hashes of n-grams with log2 probabilities by language, and of contexts with the log2 weight left for shorter ones."""

    def __init__(self, languages: list[str], levels: list[tuple], unknown: np.ndarray):
        self.languages, self.levels, self.unknown = languages, levels, unknown
        self.limits = np.full(len(languages), np.inf)

    @staticmethod
    def fit(languages: list[str], lang: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Model:
        """codes: (rows, ORDER) code points of n-grams, lang: number of each row's language. Counts of shorter n-grams are numbers of different letters before them."""
        size, levels = len(languages), [None] * (ORDER + 1)
        rows_lang, rows_codes, rows_n = lang, codes, counts
        tables = {}
        for n in range(ORDER, 0, -1):
            h = np.zeros(len(rows_codes), np.uint64)
            context = h
            for k in range(1, n + 1):
                context, h = h, mix(h * np.uint64(31) + rows_codes[:, k - 1].astype(np.uint64) + np.uint64(k << 32))
            tail = np.zeros(len(rows_codes), np.uint64)
            for k in range(1, n):
                tail = mix(tail * np.uint64(31) + rows_codes[:, k].astype(np.uint64) + np.uint64(k << 32))
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            c = np.zeros((len(keys), size))
            np.add.at(c, (back, rows_lang), rows_n)
            tables[n] = (keys, c, context[first], tail[first])
            # different n-grams of a language, without their first letter
            place, owner = np.nonzero(c)
            rows_lang, rows_codes, rows_n = owner, rows_codes[first][place][:, 1:], np.ones(len(place))
        letters_seen = len(tables[1][0])
        lower = np.full((1, size), 1.0 / (letters_seen + 1))
        lower_keys = np.zeros(1, np.uint64)
        for n in range(1, ORDER + 1):
            keys, c, context, tail = tables[n]
            n1, n2 = (c == 1).sum(0), (c == 2).sum(0)
            d = np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
            contexts, back = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, back, c), np.add.at(kinds, back, c > 0)
            rest = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(c - d, 0) / np.maximum(total[back], 1) + rest[back] * lower[np.searchsorted(lower_keys, tail)]
            levels[n] = (keys, np.log2(p).astype(np.float32), contexts, np.log2(rest).astype(np.float32))
            lower, lower_keys = p, keys
        unknown = np.full(size, np.log2(1.0 / (letters_seen + 1)), np.float32)
        return Model(languages, levels, unknown)

    def bits(self, c: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log2 probability of each place of the joined texts c, for each language. A place's context reaches back to its text's beginning at most."""
        h = grams(c)
        out = np.zeros((len(c), len(self.languages)), np.float32)
        begins = np.r_[0, ends[:-1]]
        depth = np.arange(len(c)) - np.repeat(begins, np.diff(np.r_[0, ends])) + 1
        todo = np.arange(len(c))
        for n in range(ORDER, 0, -1):
            keys, p, contexts, rest = self.levels[n]
            able = depth[todo] >= n
            now, skipped = todo[able], todo[~able]
            g = h[n][now - n + 1]
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[at] == g
            out[now[hit]] += p[at[hit]]
            missed = now[~hit]
            g = h[n - 1][missed - n + 1]
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            known = contexts[at] == g
            out[missed[known]] += rest[at[known]]
            todo = np.r_[missed, skipped]
        out[todo] += self.unknown
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, bits a letter of the best language) of each text."""
        cs = [letters(t) for t in texts]
        used = [i for i, c in enumerate(cs) if len(c)]
        out: list[tuple] = [("und", 0.0, True, None)] * len(texts)
        if not used or not self.languages:
            return out
        ends = np.cumsum([len(cs[i]) for i in used])
        b = self.bits(np.concatenate([cs[i] for i in used]), ends)
        totals = -np.add.reduceat(b.astype(np.float64), np.r_[0, ends[:-1]], axis=0)
        for row, i in enumerate(used):
            n = len(cs[i]) - 1
            mean = totals[row] / n
            best = int(mean.argmin())
            score = 1.0 / float(np.exp2(-(mean - mean[best]) * min(n, SCORE_LETTERS)).sum())
            out[i] = (self.languages[best], score, bool(n >= LEAST_LETTERS and mean[best] > self.limits[best] + MARGIN_BITS), float(mean[best]))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 512):
        langs = b.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            rows = [letters(t) for t, x in zip(b.column("text").to_pylist(), langs, strict=True) if x == lang]
            parts = [np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in rows if len(c) >= ORDER]
            if parts:
                g, n = np.unique(np.concatenate(parts), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype("<u4").tobytes()[i : i + 4 * ORDER].decode("utf-32-le") for i in range(0, g.nbytes, 4 * ORDER)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


_SCHEMA = "lang_pred string, score double, rejected boolean, bits double"


def _apply(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 128):
            found = model.predict(b.column("text").to_pylist())
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *columns], names=[*keep, "lang_pred", "score", "rejected", "bits"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, {_SCHEMA}")


def fit(docs: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Fit on at most SAMPLE_ROWS labelled documents of each language whose crc32(doc_id as text) mod folds is not `held`; a share of them only calibrates rejection.

    The n-gram table that reaches the driver, and the model that goes to the tasks, are bounded by that sample.
    """
    scratch = Scratch(docs.sparkSession, "lang-id")
    usable = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = usable.where(F.length("text") > 0).select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_ROWS)
    picked = scratch.keep(picked.dropDuplicates(["doc_id", "lang"]))
    ids = picked.select("doc_id", "lang", "place")
    sample = scratch.keep(usable.join(F.broadcast(ids) if picked.count() <= BROADCAST_IDS else ids, ["doc_id", "lang"]).select("lang", "text", "place"))
    table = sample.where(F.col("place") % CALIBRATION_SHARE != 0).select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if not languages:
        return Model([], [], np.empty(0, np.float32))
    codes = np.frombuffer("".join(table.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    number = {x: i for i, x in enumerate(languages)}
    model = Model.fit(languages, np.array([number[x] for x in table.column("lang").to_pylist()]), codes, table.column("n").to_numpy().astype(float))
    held_back = _apply(sample.where(F.col("place") % CALIBRATION_SHARE == 0), model, ["lang"])
    for r in held_back.where(F.col("lang") == F.col("lang_pred")).groupBy("lang").agg(F.max("bits").alias("bits")).collect():
        model.limits[number[r.lang]] = r.bits
    return model


def identify(docs: DataFrame, folds: int = 4, held: int = 2, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default), lang_pred, score (0 to 1), rejected and bits (a letter) of every whole text.

    lang_pred is the learned language of the lowest cross-entropy by letter; `und` with score 0, rejected, if the text is null or has
    no letter, or nothing could be learned. Ties go to the first language by code point. `rejected` also marks texts of LEAST_LETTERS letters or more whose
    cross-entropy passes the language's calibrated limit. Only the text decides. Null ids and repeated rows are predicted like others.
    """
    return _apply(docs.withColumn("text", F.col("text").cast("string")), fit(docs, folds, held), keep or ["doc_id"])
