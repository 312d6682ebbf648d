import random
import re
import zlib
from collections import Counter

import pytest

from flowlens.llm import variants as op
from flowlens.llm.queries import op13_spelling_variants


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    i = 0
    while i < len(u) and u[i] == v[i]:
        i += 1
    return u != v and (u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else len(v) == len(u) + 1 and u[i:] == v[i + 1 :])


def counted(rows):
    c = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if n >= 5 and len(w) >= 6}


def grouped(words):
    places = {}
    for w in words:
        for k in range(len(w) + 1):
            places.setdefault((w[:k], w[k:]), []).append(w)
            if k < len(w):
                places.setdefault((w[:k], w[k + 1 :]), []).append(w)
    close = {w: set() for w in words}
    for g in places.values():
        for u in g:
            close[u] |= {v for v in g if near(u, v)}
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in close[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_composition(seed):
    """All pairs of random strings over two letters, the empty one included; every pair once."""
    r = random.Random(seed)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(8))) for _ in range(60)})
    a = op.Acceptor(words)
    out = list(op.composed(a))
    assert len(out) == len(set(out)) and {frozenset(p) for p in out} == {frozenset((u, v)) for u in words for v in words if near(u, v)}
    assert all(len(u) <= len(v) for u, v in out)


def test_acceptor_is_minimal():
    """tap, taps, top, tops: endings are shared."""
    a = op.Acceptor(["tap", "taps", "top", "tops"])
    reached, stack = {0}, [0]
    while stack:
        for q in a.arcs[stack.pop()].values():
            if q not in reached:
                reached.add(q)
                stack.append(q)
    assert len(reached) == 5


@pytest.mark.parametrize("limit", [3, 4000])
def test_pairs(spark, monkeypatch, limit):
    """With a limit of 3 words, states are split until little is left."""
    monkeypatch.setattr(op, "STATE_WORDS", limit)
    r = random.Random(7)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 10))) for _ in range(300)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    out = [(x.a, x.b) for x in op.near_pairs(df).collect()]
    assert len(out) == len(set(out)) and {frozenset(p) for p in out} == {frozenset((u, v)) for u in words for v in words if near(u, v)}


def test_groups(spark):
    r = random.Random(5)
    base = ["colour", "favours", "größere", "éléments", "sentence"]
    rows = []
    for i in range(900):
        w = base[min(r.randrange(12), 4)]
        for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", "e", "ö", "x"]) + w[k + 1 :]
        rows.append((i % 70, f"{w.upper() if i % 9 == 0 else w}, {w}-7"))
    rows += [(None, "sentence sentence"), (3, None), (4, ""), (5, "a" * 100_000)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as run").repartition(4)
    words = op.vocabulary(df, slip_every=199)
    assert {x.word: x.n for x in words.collect()} == counted(rows)
    cols = "word form root n n_near form_n".split()
    want = grouped(counted(rows))
    assert sorted(tuple(x) for x in op.group_variants(words).select(cols).collect()) == want
    assert len({x[2] for x in want if x[1]}) >= 2


def test_chain(spark):
    """Forms of forms lead to the last one; ties go to the smallest word."""
    rows = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("zzzzzz", 9), ("zzzzzy", 45), ("zzzzzx", 45), ("lonely", 7)]
    out = {x.word: (x.form, x.root, x.n_near, x.form_n) for x in op.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert out["aaaaaa"] == ("aaaaab", "aabbbb", 1, 25) and out["aabbbb"] == (None, "aabbbb", 1, None)
    assert out["zzzzzz"] == ("zzzzzx", "zzzzzx", 2, 45) and out["lonely"] == (None, "lonely", 0, None)


def test_empty(spark):
    words = op.vocabulary(spark.createDataFrame([], "doc_id long, text string"), slip_every=199)
    assert op.group_variants(words).count() == 0


def test_given_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = grouped(counted(rows))
    assert sorted(tuple(x) for x in op13_spelling_variants(spark, d).select("word", "form", "root", "n", "n_near", "form_n").collect()) == want
    assert any(x[1] for x in want)
