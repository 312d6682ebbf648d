"""Operator 5: licence scan with a trained paragraph classifier, in DataFrame functions and Spark ML only."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound, let, words

#: Sentences of public licence notices, by family (fixed values).
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: The class of paragraphs without a licence.
UNKNOWN = "unknown"
#: How often each template counts in the fit, and for how many examples all corpus paragraphs without a licence count there together, so that their number does not outweigh the templates.
REPEATS, PLAIN_WEIGHT = 20, 2000
#: Paragraphs that `negatives` shows (nothing is learnt from them).
NEGATIVES = 4000
#: Words of a licence notice that make a corpus paragraph unfit as an example without one.
CUES = "(?i)licen[cs]e|copyright|spdx|permission|redistribut|warrant"
#: Lowest calibrated probability, and share of some template's word pairs that a paragraph must hold to be confirmed.
LEAST_PROBABILITY, LEAST_CONFIRMED = 0.6, 0.6
#: Lines of the longest window in which a wrapped notice is looked for.
BLOCK = 8


def _marks_out(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens, without marks at either end, between blanks."""
    return F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}.-]+|[.-]+(?=\\s|$)", " "))


def _pairs(ws: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def featured(paragraphs: DataFrame) -> DataFrame:
    """Adds ws (words) and pairs (different pairs of neighbours) to a table with a column paragraph."""
    tokens = bound(paragraphs, plain=_marks_out(F.col("paragraph")))
    return bound(tokens.withColumn("ws", words(F.col("plain"))).drop("plain"), pairs=F.when(F.size("ws") > 1, _pairs(F.col("ws"))).otherwise(F.array().cast("array<string>")))


def paragraphs_of(docs: DataFrame) -> DataFrame:
    split = docs.select(F.col("doc_id").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("place", "paragraph"))
    return split.where(F.col("paragraph").rlike("[^\\x20\\x09-\\x0D]"))


def template_pairs(spark) -> list:
    return featured(spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, paragraph string")).select("family", "pairs").collect()


def telling_words(templates: list) -> list[str]:
    """Few words without any of which no text holds LEAST_CONFIRMED of a template: long ones first, those in most pairs of the templates that are not settled yet."""
    out = set()
    while open_ := [t for t in templates if sum(not out & set(p.split(" ")) for p in t.pairs) >= LEAST_CONFIRMED * len(t.pairs)]:
        gain = Counter(w for t in open_ for p in t.pairs if not out & set(p.split(" ")) for w in set(p.split(" ")))
        out.add(max(gain, key=lambda w: (min(len(w), 6), gain[w], w)))
    return sorted(out)


def tells(text: Column, telling: list[str]) -> Column:
    """Whether a text holds a telling word, in any case."""
    parts = [w for w in telling if not any(v != w and v in w for v in telling)]
    return let(F.lower(text), lambda x: reduce(Column.__or__, [x.contains(w) for w in parts]))


def telling_lines(docs: DataFrame, telling: list[str]) -> DataFrame:
    """(doc_id, place, paragraph) of the lines with a telling word; no other line holds LEAST_CONFIRMED of a template."""
    at = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where(tells(F.col("text"), telling))
    return paragraphs_of(at).where(tells(F.col("paragraph"), telling))


def wrapped(docs: DataFrame, held: dict[str, Column], telling: list[str]) -> DataFrame:
    """(doc_id, place, wanted, paragraph): the shortest window of 2 to BLOCK lines from each line, without a blank line in it, that holds LEAST_CONFIRMED of a template of the family `wanted`.

    Marks of comments are no tokens, so lines need only be joined. Texts and windows without a telling word are passed over, which loses nothing; nor does it
    to look at windows only in texts that hold enough as a whole, and at the shorter windows from a line only where the longest does.
    """
    enough = F.array_compact(F.array(*[F.when(share >= LEAST_CONFIRMED, F.lit(f)) for f, share in held.items()]))

    def holding(texts: DataFrame, paragraph: Column) -> DataFrame:
        return bound(featured(texts.withColumn("paragraph", paragraph)), enough=enough).where(F.size("enough") > 0)

    at = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where(tells(F.col("text"), telling) & F.contains("text", F.lit("\n")))
    at = holding(at, F.col("text")).select("doc_id", F.split("text", "\n").alias("lines"))
    # lines far from a telling word are passed over before any window is made
    near = bound(at, told=F.transform("lines", lambda x: tells(x, telling)), seen=F.transform("lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    starts = F.transform("lines", lambda _, i: F.when(F.exists(F.slice("told", i + 1, BLOCK), lambda t: t), F.struct(i.alias("place"), F.slice("lines", i + 1, BLOCK).alias("w"), F.slice("seen", i + 1, BLOCK).alias("seen"))))
    at = near.select("doc_id", F.explode(F.array_compact(starts)).alias("x")).select("doc_id", "x.*")
    blank = F.array_position("seen", False)
    at = bound(at, most=F.when(blank > 0, blank.cast("int") - 1).otherwise(F.size("w"))).where("most > 1").select("doc_id", "place", "most", "w")
    window = F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")
    longest = holding(at.withColumn("n", F.col("most")), window).select("doc_id", "place", "most", "w")
    found = holding(longest.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("most")))), window).select("doc_id", "place", "n", "paragraph", F.explode("enough").alias("wanted"))
    return found.groupBy("doc_id", "place", "wanted").agg(F.min(F.struct("n", "paragraph"))["paragraph"].alias("paragraph"))


def plain_paragraphs(docs: DataFrame) -> DataFrame:
    """(paragraph, h): the paragraphs without a word of a licence notice, and their hashes."""
    return paragraphs_of(docs).where(~F.col("paragraph").rlike(CUES)).select("paragraph", F.xxhash64("paragraph").alias("h"))


def plain_examples(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(ws, fits, n): all different paragraphs of the corpus without a word of a licence notice, as the words that they share with templates, and how many paragraphs
    share just these. Half of them by hash fit, the others calibrate. A line that is repeated all over the corpus counts once.
    """
    known = F.array(*[F.lit(w) for w in vocabulary])
    plain = bound(plain_paragraphs(docs), plain=_marks_out(F.col("paragraph")))
    seen = plain.select("h", F.array_sort(F.array_intersect(words(F.col("plain")), known)).alias("ws"), (F.pmod("h", F.lit(2)) == 0).alias("fits"))
    return seen.groupBy("ws", "fits", "h").count().groupBy("ws", "fits").agg(F.count("*").alias("n"))


def negatives(docs: DataFrame) -> DataFrame:
    """(paragraph, h): NEGATIVES different corpus paragraphs without a word of a licence notice, those of smallest hash; all, if there are fewer. To look at; `train` takes all.

    A line that is repeated all over the corpus counts once. Only paragraphs below a hash bound, about twice as many as are wanted, are told apart and sorted.
    """
    plain = plain_paragraphs(docs)
    different = plain.agg(F.approx_count_distinct("h").alias("n")).first().n
    order = F.shiftrightunsigned("h", 1)
    if different > 2 * NEGATIVES:
        plain = plain.where(order < int(2**63 * (2 * NEGATIVES / different)))
    return plain.distinct().orderBy(order, "paragraph").limit(NEGATIVES)


def train(docs: DataFrame, scratch: Scratch) -> tuple[PipelineModel, list[str], float]:
    """Fit on the templates and on all corpus paragraphs without a licence; returns model, family names and the calibrated probability a prediction must reach.

    The features are the words of the templates, so that paragraphs that share the same ones are one row with a weight. Half of the different
    paragraphs only calibrate: the limit lies above all probabilities that they get.
    """
    spark = docs.sparkSession
    names = [UNKNOWN, *sorted(TEMPLATES)]
    known = featured(spark.createDataFrame([(t, float(names.index(f))) for f, ts in TEMPLATES.items() for t in ts], "paragraph string, label double"))
    vocabulary = sorted({w for r in known.select("ws").collect() for w in r.ws})
    plain = scratch.keep(plain_examples(docs, vocabulary))
    total = plain.where("fits").agg(F.sum("n").alias("n")).first().n or 0
    each = min(1.0, PLAIN_WEIGHT / max(1, total))
    examples = known.select("ws", "label", F.lit(float(REPEATS)).alias("weight")).union(plain.where("fits").select("ws", F.lit(0.0), F.col("n") * each))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="ws", outputCol="features")
    counted.setBinary(True)
    data = scratch.keep(counted.transform(examples).select("features", "label", "weight"), plain.count())
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.002, maxIter=40, standardization=False).fit(data)
    model = PipelineModel([counted, fitted])
    top = model.transform(plain.where("not fits")).agg(F.max(1 - F.get(vector_to_array("probability"), F.lit(0))).alias("p")).first().p
    return model, names, max(LEAST_PROBABILITY, min(0.95, (top or 0.0) + 0.05))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, families (sorted), licence_places (paragraph numbers, from 0), confidence (highest probability, null without a licence) of every document row.

    Paragraphs are the lines with a visible character. Each gets the most probable family; it counts where the probability reaches the
    calibrated limit and the paragraph holds LEAST_CONFIRMED of the word pairs of a template of that family, else it is unknown. Notices wrapped over
    up to BLOCK lines are judged as one text in the same way; their place is the line from which a window first holds them.

    Null and blank texts have no paragraphs. Rows that repeat a doc_id are joined into one. Extra columns are ignored. No documents: no rows.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    model, names, limit = train(docs, scratch)
    given = F.array(*[F.lit(n) for n in names])
    p = vector_to_array(F.col("probability"))
    templates = template_pairs(docs.sparkSession)
    by_family = {f: F.greatest(F.lit(0.0), *[F.size(F.array_intersect("pairs", F.array(*[F.lit(x) for x in t.pairs]))) / len(t.pairs) for t in templates if t.family == f]) for f in TEMPLATES}

    def scored(paragraphs: DataFrame, *more: str) -> DataFrame:
        return model.transform(featured(paragraphs)).select("doc_id", "place", *more, "pairs", F.get(given, F.col("prediction").cast("int")).alias("family"), let(p, F.array_max).alias("p"))

    held = F.lit(0.0)
    for f, share in by_family.items():
        held = F.when(F.col("family") == f, share).otherwise(held)
    likely = (F.col("family") != UNKNOWN) & (F.col("p") >= limit)
    telling = telling_words(templates)
    single = scored(telling_lines(docs, telling)).where(likely & (held >= LEAST_CONFIRMED)).select("doc_id", "place", "family", "p", F.lit(1).alias("single"))
    joined = scored(wrapped(docs, by_family, telling), "wanted").where(likely & (F.col("family") == F.col("wanted")))
    joined = scratch.keep(joined.select("doc_id", "place", "family", "p", F.lit(0).alias("single")))
    single = scratch.keep(single)
    # a window is a notice of its own only if none of the family, wrapped or not, begins in the lines that it covers or on the line before
    marks = joined.union(single).select(F.col("doc_id").alias("i"), F.col("place").alias("at"), F.col("family").alias("f"), F.col("single").alias("alone")).distinct()
    other = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("family") == F.col("f"))
    near = (F.col("at") == F.col("place") - 1) | ((F.col("alone") == 1) & F.col("at").between(F.col("place"), F.col("place") + BLOCK - 1))
    found = single.union(joined.join(marks, other & near, "left_anti")).groupBy(F.col("doc_id").alias("__id")).agg(
        F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("place")).alias("licence_places"), F.max("p").alias("confidence"),
    )
    # the first visible character of a line and what follows it in the line
    visible = F.regexp_count(F.col("text").cast("string"), F.lit("[^\\x20\\x09-\\x0D][^\\n]*"))
    every = docs.select(F.col("doc_id").alias("doc_id"), visible.alias("n")).groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_paragraphs"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("licence_places", F.array().cast("array<int>")).alias("licence_places"), "confidence")
