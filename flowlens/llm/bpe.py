"""Operator 9: byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: How byte-level BPE cuts a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Frequent words whose ids are kept by a worker, and words that are merged at once.
KEPT_WORDS = 150_000
#: Below this code point the categories of the regex module and of the tokenizer's own splitter are the same in every Unicode version in use.
SAME_UP_TO = 0x250


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: visible Latin-1 stands for itself, the rest is counted up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary file: merge pairs as one sorted array of packed keys, with rank and result beside it."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, letters = spec["model"], _byte_alphabet()
        self.path, vocab = path, model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern, self.rare = regex.compile(PATTERN), regex.compile(f"[{chr(SAME_UP_TO)}-\U0010ffff]")
        first = np.zeros(256, np.int64)
        for c, b in letters.items():
            first[b] = vocab[c]
        self.first = first
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.known: dict[str, list[int]] = {}
        self._splitter = None

    def split(self, text: str) -> list[str]:
        if not self.rare.search(text):
            return self.pattern.findall(text)
        if self._splitter is None:  # rare letters: only the splitter is the library's, for its Unicode tables
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def merge(self, new: list[str]) -> list[list[int]]:
        """Ids of many words at once. Each round finds, in every word, the lowest-rank pair, and merges its places from the left."""
        raw = [w.encode() for w in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_word, done_sym, done_at = [], [], []
        at = np.arange(len(sym))
        none = np.iinfo(np.int64).max
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = (self.keys[i] == key) & (word[:-1] == word[1:])
            rank = np.where(found, self.ranks[i], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(np.r_[rank, none], starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            ended = np.repeat(low == none, lengths)
            done_word.append(word[ended]), done_sym.append(sym[ended]), done_at.append(at[ended])
            hit = np.r_[rank == np.repeat(low, lengths)[:-1], False] & ~ended
            # of overlapping places (a a a) every other one counts, from the left of each run
            place = np.arange(len(sym))
            begin = hit & ~np.r_[False, hit[:-1]]
            hit &= (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
            sym = sym.copy()
            where = np.flatnonzero(hit)
            sym[where] = self.results[i[where]]
            stay = ~ended
            stay[where + 1] = False
            sym, word, at = sym[stay], word[stay], at[stay]
        if not done_sym:
            return []
        word, sym, at = map(np.concatenate, (done_word, done_sym, done_at))
        sym, counts = sym[np.lexsort((at, word))], np.bincount(word, minlength=len(raw))
        flat, ends = sym.tolist(), np.cumsum(counts).tolist()
        return [flat[e - c : e] for e, c in zip(ends, counts.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = []
        for t in texts:
            parts = [] if not t else self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]
            cut.append([w for p in parts for w in ([p] if p in self.special else self.split(p))])
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in {w for ws in cut for w in ws} if w not in known and w not in self.special]
        known.update(zip(new, self.merge(new), strict=True))
        known.update({s: [i] for s, i in self.special.items()})
        return [[i for w in ws for i in known[w]] for ws in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded text: each whole text encoded and decoded again. A null text counts as empty; an empty one has no ids. Extra columns are ignored; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in small_batches(batches, 128):
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encoding, digested where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in small_batches(batches, 128):
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join(map(str, x))) for x in ids]), pa.array([sha(bpe.decode(x)) for x in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
