import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm.common import Scratch
from flowlens.llm.graph import components
from flowlens.llm.near_dedup import near_duplicates


def sets_of(text):
    ws = [] if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(s), low[root(k)], i == low[root(k)]) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_components(spark):
    random.seed(3)
    path = [(i, i + 1) for i in range(100)] + [(1000, 1000), (2000, 2001), (2001, 2000)] + [(5000, 5000 + i) for i in range(1, 200)]
    random.shuffle(path)
    out = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long"), Scratch(spark, "t")).collect()}
    assert len({out[i] for i in range(101)}) == 1 and out[2000] == out[2001] and len({out[5000 + i] for i in range(200)}) == 1
    assert 1000 not in out and len(set(out.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "x" * 50_000)]
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([6, 12, 60, 200]))]
        for _ in range(r.choice([1, 2, 9, 40])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((10 + len(rows), " ".join(t)))
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).repartition(4)
    assert got(near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("size", [150, 400])
def test_dense_group_of_variants(spark, size):
    """A group whose members are close to a few others only: no leader links them all."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(size):
        t = list(base)
        for _ in range(4):
            t[r.randrange(300)] = f"v{r.random()}"
        rows.append((i, " ".join(t)))
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_null_ids(spark):
    """A row without an id links others and is told apart by its text: texts of 81 and 82 shingles with 81 in common."""
    base = [f"w{i}" for i in range(85)]
    rows = [(None, " ".join(base)), (7, " ".join([*base, "more"])), (None, "words of its own that nothing else has at all"), (None, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out))) == sorted(map(str, [(None, 81, 7, False), (7, 82, 7, True), (None, 6, None, False), (None, 0, None, False)]))


@pytest.mark.parametrize("similarity", [0.6, 0.75])
def test_corpus_without_near_copies(spark, similarity):
    """Pairs that share lists but are no near copies: nothing is linked, every row is kept."""
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(200)]
        n = round(200 * similarity)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:n] + [f"g{g}v{i}" for i in range(200 - n)]))]
    out = got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows) and all(r[3] for r in out)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
