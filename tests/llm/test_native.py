"""Quality rules, mixing, line dedup and licence scan against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest

from flowlens.llm import licenses, line_dedup, mixing, quality

ODD = [(900, None, None, None), (901, "", None, "src1"), (902, " \n\t\n", "en", None), (903, "one two", "xx", "src1"), (None, "the of and " * 40, "en", "src2"), (904, "w " * 30_000, "en", "src2"), (904, "w " * 30_000, "en", "src2"), (905, "a b c d e f g h\n" * 3 + "x" * 9000, None, "é")]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as size", "2 as kept", "3 as place", "4 as bucket").repartition(4)


def split(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_quality_base(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    want = Counter()
    for i, t, _, _ in rows:
        ws = split(t)
        seen = [x for x in (t or "").split("\n") if split(x)]
        n = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        marked = {k + j for k in range(len(ws) - 7) if n[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        want[i, len(ws), len("".join(ws)), sum(c in "#*$%&|<>" for c in t or ""), len(seen) - len(set(seen)), len(marked), len(ws) < 20 or 100 * len(marked) > 30 * len(ws)] += 1
    assert got == want
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_verdict(spark, docs):
    junk = "Te%%% ou*** ie### na%%% ré### au*** # * $ % & | < > " * 30
    out = {r.doc_id: r for r in quality.quality(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(5000, junk, "en")], "doc_id long, text string, lang string"))).collect()}
    assert not out[5000].kept
    rest = [r for i, r in out.items() if i != 5000 and not r.base_failed and i is not None and i < 900]
    assert sum(r.kept for r in rest) > 0.9 * len(rest)


def test_quality_without_common_words(spark):
    """Lower-case gibberish has normal character classes; only its words tell."""
    r = random.Random(2)
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(10_000_000 + i, " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n)) + ".", "en") for i, n in enumerate([80, 150, 300, 900])]
    out = {x.doc_id: x for x in quality.quality(plain.union(spark.createDataFrame(junk, plain.schema))).collect()}
    assert all(out[i].class_distance < quality.MOST_CLASS_DISTANCE and not out[i].base_failed and not out[i].kept for i, _, _ in junk)
    good = [x.doc_id for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()]
    assert sum(out[i].kept for i in good if not out[i].base_failed) > 0.97 * sum(not out[i].base_failed for i in good)


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(split(t))) for i, t, _, _ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, live = {}, 1.5 * sum(sizes.values()), list(order)
    while live:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if share[s] >= 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        live = [s for s in live if s not in over]
    assert {(r.source_size, round(r.target, 3)) for r in out} == {(sizes[s], round(target[s], 3)) for s in order}
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[round(r.target, 3)] += r.taken
    for t, n in Counter(round(x, 3) for x in target.values()).items():
        assert taken[t] == pytest.approx(t * n, rel=0.02, abs=40)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_draws(docs, monkeypatch):
    """Shards' counts are free multinomial draws of the sources' shares; the slots taken meet every source's total, each slot once, and no block more than twice."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    monkeypatch.setattr(mixing, "SHARD_GROUP", 4)
    monkeypatch.setattr(mixing, "CELLS", 16)
    m = mixing.Mixture(docs)
    shards = m.shards().collect()
    slots = {r.no: r.slots for r in m.sources.collect()}
    n = m.n_slots
    width = lambda k: min(64, n - 64 * k)
    by_shard, taken, drawn = Counter(), Counter(), Counter()
    for r in shards:
        by_shard[r.shard] += r.drawn
        taken[r.no] += r.slots
        drawn[r.no] += r.drawn
    whole = range(-(-n // 64))
    assert dict(by_shard) == {k: width(k) for k in whole} and all(taken[i] == k for i, k in slots.items())
    assert any(drawn[i] != k for i, k in slots.items())
    # goodness of fit over shards and sources: the mean of a chi-square is its degrees of freedom
    counts = {(r.shard, r.no): r.drawn for r in shards}
    big = [i for i, k in slots.items() if k >= n // 50]
    fit = sum((counts.get((k, i), 0) - width(k) * slots[i] / n) ** 2 / (width(k) * slots[i] / n * (1 - slots[i] / n)) for k in whole for i in big)
    cells = len(whole) * len(big)
    assert abs(fit - cells) < 6 * (2 * cells) ** 0.5
    moved = sum(max(r.drawn - r.slots, 0) for r in shards)
    assert moved <= 6 * n**0.5 * len(slots) ** 0.5
    rows = m.slots.collect()
    assert sorted(r.slot for r in rows) == list(range(n)) and all(r.slot // 64 == r.shard for r in rows)
    assert max(Counter((r.no, r.block) for r in rows).values()) <= 2
    assert len({(r.no, r.block, r.use) for r in rows}) == n
    assert mixing.Mixture(docs.limit(0)).shards().count() == 0


def test_mixed_documents(docs):
    m = mixing.mixed_documents(docs)
    words = Counter()
    for r in m.collect():
        words[r.doc_id] += len(split(r.text))
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +words == +want and m.columns == docs.columns


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog near the quiet river bank while the sun goes down and the moon comes up"
    near, other = base.replace("lazy", "hazy"), "an entirely different sentence about mountains, snow and the long road that leads across the pass to the valley"
    rows = [(1, f"{base}\n{other}\n\n{base}"), (2, f"own words\n{near}"), (3, None), (4, ""), (5, f"{other}x\nown wordz\nab\nab"), (None, "only here, before all others"), (6, "only here, before all others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as place", "2 as h", "length(text) as n_chars")
    out = {r.doc_id: (r.n_lines, r.dropped) for r in line_dedup.duplicate_lines(docs).collect()}
    assert out == {1: (3, [3]), 2: (2, [1]), 3: (0, []), 4: (0, []), 5: (4, [0, 3]), None: (1, []), 6: (1, [0])}
    clean = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(docs).collect()}
    assert clean == {1: f"{base}\n{other}\n", 2: "own words", 3: None, 4: "", 5: "own wordz\nab", None: "only here, before all others"}
    assert line_dedup.duplicate_lines(docs.limit(0)).count() == 0


def test_line_dedup_links_without_a_leader(spark):
    """Lines that share all band keys and are unlike, but for two that no leader round pairs: the last round links them."""
    from pyspark.sql import functions as F

    r = random.Random(11)
    short = spark.createDataFrame([("".join(w),) for w in product("qwxyzjkv", repeat=5)], "w string").orderBy(F.shiftright(F.xxhash64("w", F.lit(1)), 32).cast("int")).limit(4)
    common = " ".join(x.w for x in short.collect())
    rows = [(i, common + " " + "".join(r.choice("abcdefghilmnoprstu ") for _ in range(50)) + "s") for i in range(150)]
    rows.append((150, rows[7][1][:-1] + "t"))
    out = {x.doc_id: x.dropped for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, d in sorted(out.items()) if d] == [150]


def test_line_dedup_without_blanks(spark):
    """Long lines without U+0020 that differ in one of their first eight characters, and lines whose repeated passages differ in length."""
    r = random.Random(3)
    cjk, code = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(300)), "".join(r.choice("0123456789abcdef\t/") for _ in range(240))
    texts = [cjk, cjk[:3] + "x" + cjk[4:], code, code[:6] + "#" + code[7:], "=" * 60, "=" * 160]
    out = {x.doc_id: x.dropped for x in line_dedup.duplicate_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i, d in sorted(out.items()) if d] == [1, 3, 5]


def _line_sets(line):
    return {line} if len(line) < 5 else {line[i : i + 5] for i in range(len(line) - 4)}


def _edited(line, r):
    """A copy with as many edits as keep the similarity at 0.8 or more, and its similarity."""
    own, last = _line_sets(line), line
    while True:
        at = r.randrange(len(last))
        new = last[:at] + r.choice("etaoinshrdlu0123 ") + last[at + r.randrange(2) :]
        sets = _line_sets(new)
        if len(own & sets) < 0.8 * len(own | sets) or r.random() < 0.05:
            return last
        last = new


def test_line_dedup_recall(spark):
    """Lines of 20 to 2,000 characters with and without blanks and in other scripts, each with a copy at similarity 0.8 or more; no other pair comes near."""
    r = random.Random(17)
    kinds = ["abcdefghijklmnopqrstuvwxyz      ", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "".join(map(chr, range(0x4E00, 0x5600))), "".join(map(chr, range(0x430, 0x450))) + "    "]
    lines = [("".join(r.choice(kinds[i % 5]) for _ in range(int(20 * 100 ** r.random()))).strip() or "x" * 20) for i in range(1000)]
    pairs = [(a, _edited(a, r)) for a in lines]
    rows = [(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (a, b) in enumerate(pairs) if a != b]
    out = {x.doc_id: x.dropped for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    copies = [i for i, _ in rows if i >= 1000]
    assert sum(out[i] == [0] for i in copies) >= 0.95 * len(copies) and len(copies) > 750
    assert not any(out[i] for i in range(1000))


def test_line_dedup_postings_are_narrow(spark, monkeypatch):
    """What is written with every posting of all lines holds names only; lists and signatures are those of the lines."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ijkl") for _ in range(rng.choice([40, 140, 400]))) for _ in range(60)]
    corpus = spark.createDataFrame([(i, t + "\n" + t[:-3] + "xyz") for i, t in enumerate(texts)], "doc_id long, text string")
    written, keep = [], line_dedup.Scratch.keep
    monkeypatch.setattr(line_dedup.Scratch, "keep", lambda self, df, *a, **b: written.append(df.columns) or keep(self, df, *a, **b))
    job = line_dedup._Job(corpus)
    posted = job.posted().collect()
    assert written[1:3] == [["key"], ["key", "h", "every"]]
    lines, lists = {r.h: r for r in job.lines.collect()}, defaultdict(set)
    for r in posted:
        kind = "every" if r.every else "sample"
        assert (r.m0, r.m1, r.n) == tuple(lines[r.h][f"{kind}_{c}"] for c in ("m0", "m1", "n"))
        lists[r.key].add(r.h)
    assert len(lists) >= 60 and min(map(len, lists.values())) > 1 and len(posted) == sum(map(len, lists.values()))


def test_line_dedup_settles_short_lists_at_once(spark, monkeypatch):
    """Lists of up to three lines are paired in full in the first round: no later round gets them, and the copies go."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ijkl") for _ in range(150)) for _ in range(20)]
    rows = [(3 * i + j, t[: -1 - j] + "xyz"[j] * (1 + j)) for i, t in enumerate(texts) for j in range(3)]
    later, opened = [], line_dedup._Job.open_lists
    monkeypatch.setattr(line_dedup._Job, "open_lists", lambda self, members: later.append(members.count()) or opened(self, members))
    out = {x.doc_id: x.dropped for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == ([0] if i % 3 else []) for i, _ in rows) and later == [0]


def test_line_dedup_settles_lists_of_many_unlike_lines(spark, monkeypatch):
    """Lists of forty lines that share their keys by a common passage: all their pairs are made in the first round, no later round gets a line, and the one copy goes."""
    r = random.Random(11)
    common = "".join(r.choice("qwxyzjkv ") for _ in range(60))
    rows = [(i, common + "".join(r.choice("abcdefghilmnoprstu ") for _ in range(60)) + "s") for i in range(40)]
    rows.append((40, rows[7][1][:-1] + "t"))
    sizes, later, within, opened = [], [], line_dedup._Job.within, line_dedup._Job.open_lists
    monkeypatch.setattr(line_dedup._Job, "within", lambda self, members, lists: sizes.extend(x["count"] for x in members.groupBy("key").count().collect()) or within(self, members, lists))
    monkeypatch.setattr(line_dedup._Job, "open_lists", lambda self, members: later.append(members.count()) or opened(self, members))
    out = {x.doc_id: x.dropped for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i, d in sorted(out.items()) if d] == [40] and out[40] == [0]
    assert max(sizes) > 3 and later == [0]


def test_line_dedup_parities(spark):
    """Maps differ in no more bits than sets in shingles, so that no similar pair is lost, and tell unlike lines of up to 1,500 characters apart."""
    r = random.Random(23)
    lines = ["".join(r.choice("abcdefghijklmnopqrst     ") for _ in range(n)) for n in (3, 20, 100, 400, 900, 1500)]
    lines = [x for a in lines for x in (a, _edited(a, r))] + ["".join(r.choice("abcdefghijklmnopqrst     ") for _ in range(1500))]
    maps = line_dedup.parities(spark.createDataFrame(list(enumerate(lines)), "h long, line string")).localCheckpoint()
    sides = [maps.select(*[maps[c].alias(f"{c}_{e}") for c in maps.columns]) for e in "ab"]
    close = {(x.h_a, x.h_b) for x in sides[0].crossJoin(sides[1]).where(line_dedup._close("a", "b")).select("h_a", "h_b").collect()}
    sizes = {x.h: x.size for x in maps.collect()}
    for i, a in enumerate(map(_line_sets, lines)):
        assert sizes[i] == len(a)
        for j, b in enumerate(map(_line_sets, lines)):
            assert (i, j) in close if len(a & b) >= 0.8 * len(a | b) else (i, j) not in close or min(len(a), len(b)) < 50
    assert (10, 12) not in close


def test_line_dedup_parities_make_no_row_a_shingle(spark):
    maps = line_dedup.parities(spark.createDataFrame([(1, "x" * 9), (2, "a line of some words")], "h long, line string"))
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert "explode(set" not in plan and "Exchange" not in plan
    assert sorted((x.h, x.size) for x in maps.collect()) == [(1, 1), (2, 16)]


def test_licences(spark, docs):
    given = [(1, "Some words here that mean nothing at all\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (4, "this licence plate was released under pressure by the institute"), (5, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.")]
    both = docs.select("doc_id", "text").where("doc_id < 900").selectExpr("doc_id + 1000 as doc_id", "text").union(spark.createDataFrame(given, "doc_id long, text string"))
    out = {r.doc_id: r for r in licenses.scan(both).collect()}
    assert [out[i].families for i in range(1, 6)] == [["mit"], ["apache"], [], [], ["cc", "gpl"]] and out[1].licence_places == [1]
    for r in both.where("doc_id >= 1000").collect():
        has = any(t in (r.text or "").split("\n") for ts in licenses.TEMPLATES.values() for t in ts)
        assert bool(out[r.doc_id].families) == has, r.text


def test_licence_negatives_are_different(spark, monkeypatch):
    """A line repeated all over the corpus fills no sample; a small corpus gives all its lines."""
    monkeypatch.setattr(licenses, "NEGATIVES", 50)
    common = [(i, "the same footer on each page\nline number %d of its own" % i) for i in range(600)]
    got = [r.paragraph for r in licenses.negatives(spark.createDataFrame(common, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) == 50
    few = spark.createDataFrame([*common[:3], *common[:3], (None, None), (9, "copyright of nobody")], "doc_id long, text string")
    assert sorted(r.paragraph for r in licenses.negatives(few).collect()) == sorted({x for _, t in common[:3] for x in t.split("\n")})
    assert licenses.negatives(few.limit(0)).count() == 0


def test_licences_learn_from_all_paragraphs(spark, monkeypatch):
    """No sample: a corpus of more different lines than any bound gives all of them, each once, to fit or to calibrate."""
    monkeypatch.setattr(licenses, "negatives", None)
    text = "\n".join(f"the line number {i} of this program" for i in range(450))
    corpus = spark.createDataFrame([(i, text.replace("number ", f"number {i}x")) for i in range(20)] * 2 + [(99, text + "\nReleased under the MIT License.")], "doc_id long, text string")
    scratch = licenses.Scratch(spark, "test")
    _, _, limit = licenses.train(corpus, scratch)
    assert licenses.LEAST_PROBABILITY <= limit <= 0.95
    parts = {r.fits: r.n for r in licenses.plain_examples(corpus, ["program", "the"]).groupBy("fits").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert sum(parts.values()) == 21 * 450 and min(parts.values()) > 4000
    assert [(r.doc_id, r.licence_places) for r in licenses.scan(corpus).collect() if r.families] == [(99, [450])]


def test_wrapped_licences(spark, docs):
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights"]
    given = [(1, "\n".join(f"# {x}" for x in gpl)), (2, "words before\n\n" + "\n".join(mit)), (3, "\n".join(f" * {x}" for x in gpl[2:]))]
    both = docs.select("doc_id", "text").where("doc_id < 900").selectExpr("doc_id + 1000 as doc_id", "text").union(spark.createDataFrame(given, "doc_id long, text string"))
    out = {r.doc_id: r for r in licenses.scan(both).collect() if r.doc_id < 1000}
    assert [out[i].families for i in (1, 2, 3)] == [["gpl"], ["mit"], []]
    assert out[1].licence_places == [0] and out[2].licence_places == [2] and out[1].n_paragraphs == 4
    templates = licenses.template_pairs(spark)
    telling = set(licenses.telling_words(templates))
    assert all(sum(not telling & set(p.split(" ")) for p in t.pairs) < licenses.LEAST_CONFIRMED * len(t.pairs) for t in templates)
