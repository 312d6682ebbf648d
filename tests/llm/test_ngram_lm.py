import math
import zlib
from collections import Counter

import pytest

from flowlens.llm import ngram_lm as op


def brute(rows):
    tok = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b"\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [tok(t) for i, t in rows if i is not None and not out(i)]
    uni = Counter(w for ws in train for w in ws)
    bi = Counter(p for ws in train for p in zip([None, *ws], ws))
    n, v = sum(uni.values()), len(uni)
    after, ctx, kinds = Counter(y for _, y in bi), Counter(), {}
    for (x, _), c in bi.items():
        ctx[x] += c
        kinds.setdefault(x, Counter())[min(c, 3)] += 1
    coc = lambda c: [sum(1 for z in c.values() if z == k) for k in (1, 2, 3, 4)]
    d, dw = op.discounts(coc(bi)), op.discounts(coc(after))
    types = len(bi)
    rest = sum(dw[min(c, 3)] for c in after.values()) / types if types else 1.0

    def p(x, y):
        low = (max(after[y] - dw[min(after[y], 3)], 0) / max(types, 1)) + rest / (v + 1)
        if x not in ctx:
            return low
        return max(bi[x, y] - d[min(bi[x, y], 3)], 0) / ctx[x] + sum(d[k] * m for k, m in kinds[x].items()) / ctx[x] * low

    res = []
    for i, t in rows:
        ws = tok(t)
        res.append((i, out(i), len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), sum(math.log10(p(x, y)) for x, y in zip([None, *ws], ws))))
    return res


def same(df, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_brute(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (901, ""), (None, "the of unseenword"), (902, "Z" * 9000)]
    monkeypatch.setattr(op, "VOCABULARY_FILE", 1000)
    monkeypatch.setattr(op, "BIGRAM_FILE", 9000)
    same(op.score_documents(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as held_out_", "2 as score").repartition(3)), rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.score_documents(df).count() == 0
    one = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    same(op.score_documents(spark.createDataFrame(one, "doc_id long, text string")), one)
