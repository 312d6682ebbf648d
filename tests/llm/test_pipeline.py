import random

import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "tokens"]
    out = corpus_pipeline.run(spark, d).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()} and all(r.n_tokens > 0 for r in out)
    assert corpus_pipeline.language(spark, docs, d).columns == docs.columns


def test_near_duplicates_stage(spark):
    """Against brute force: one row of each group linked from similarity 0.8 on, whatever the ids."""
    r = random.Random(4)
    texts, groups = [None, "", "own text without any copy at all"], []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(104)]
        other = base[:50] + ["x"] + base[51:75] + ["y"] + base[76:]
        groups.append({" ".join(base), " ".join(other)})
        texts += [" ".join(base), " ".join(other)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    rows += [rows[2], rows[5]]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [x.text for x in corpus_pipeline.near_duplicate_documents(spark, docs, "").collect()]
    assert sum(t is None for t in out) == 1 and out.count("") == 1 and out.count(texts[2]) == 1
    assert all(sum(t in g for t in out) == 1 for g in groups) and len(out) == 3 + len(groups)


def test_near_duplicates_stage_without_copies(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(60))) for i in range(40)]
    out = corpus_pipeline.near_duplicate_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(tuple(x) for x in out.collect()) == rows


def test_near_duplicates_stage_is_the_same_for_any_order(spark):
    """Of a group stays the smallest id, of rows without ids the one that a hash of the text picks."""
    base = [f"w{i}" for i in range(100)]
    rows = [(9, " ".join(base)), (4, " ".join([*base, "x"])), (None, " ".join([*base, "y"])), (6, " ".join(base))]
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.near_duplicate_documents(spark, spark.createDataFrame(order, "doc_id long, text string").repartition(3), "")
        assert [x.doc_id for x in out.collect()] == [4]


def test_limits():
    from flowlens.llm.near_dedup import limits

    assert limits(85) == (40, 25, 7) and limits(80) == (35, 30, 5)


def test_stages_take_odd_rows(spark):
    """Null ids and texts, repeated rows, an empty table and columns named as the stages' own: no stage stops, and each returns the columns it was given."""
    text = "the quick brown fox and the lazy dog of the river bank were in the sun for a while and it was good to see them there"
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None, text, "en", None), (None, text, "en", None), (90001, None, None, "a"), (90002, " \n", "en", "a"), (90003, "x" * 20_000, None, "é")], "doc_id long, text string, lang string, source string")
    docs = given.union(odd).selectExpr("*", *[f"1 as `{c}`" for c in ("score", "rejected", "bits", "lang_pred", "parts", "use", "turn", "k", "h", "key", "place", "comp", "cls")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() >= 0
        assert stage(spark, docs.limit(0), "").count() == 0
    near = corpus_pipeline.near_duplicate_documents(spark, docs, "")
    assert near.where("doc_id is null").count() == 1
