from flowlens.llm.lang_id import identify
from flowlens.llm.queries import op10_language_id


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = {r.doc_id: r for r in op10_language_id(spark, d).collect()}
    held = [(r, found[r.doc_id]) for r in docs.collect() if found[r.doc_id].held_out]
    assert len(found) == docs.count() and len(held) > 100
    right = sum(a.lang == b.lang_pred for a, b in held)
    assert right / len(held) > 0.97, right / len(held)
    assert sum(b.rejected for _, b in held) / len(held) < 0.03
    assert all(0 <= b.score <= 1 for _, b in held)


def test_odd_rows(spark):
    base = [(i, ("the and of " if i % 2 else "der die und ") * 30, "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 --", "en"), (103, "the", None), (None, "und der", "xx"), (104, "漢字" * 5000, None), (104, "漢字" * 5000, None)]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as rejected", "'q' as score")
    out = {}
    for r in identify(df).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [out[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and out[103][0].lang_pred == "en" and out[None][0].lang_pred == "de"
    assert len(out[104]) == 2 and out[104][0].rejected and out[104][0].lang_pred in ("de", "en")
    assert all(r[0].lang_pred == ("en" if i % 2 else "de") for i, r in out.items() if i is not None and i < 60)
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(df.withColumn("lang", df.lang.substr(9, 0)).where("lang is null")).collect()} <= {"und"}
