"""Operator 3: quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, let, words

#: The most frequent words of each language, by language code (fixed values; public knowledge).
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
#: Character classes, each a regular expression class; blanks are counted from the words and all other characters are a class of their own (fixed values).
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": "[.,;:!?'\"()\\-]", "symbol": "[#*$%&|<>]", "foreign": "[^\\x00-\\x7F]"}
#: Words a text needs before its histograms are compared, and distances (0 to 1) above which it fails; that of words only where the corpus is too small to give a limit.
LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 50, 0.30, 0.62
#: The word distance of a text may exceed the upper quartile of its length band by so many quartile ranges; bands (powers of two of the words) and languages of fewer documents give no limit of their own.
FENCE, LEAST_BAND = 1.5, 20
#: Steps in which distances are counted for the quartiles, so that the counts of a group stay bounded.
STEPS = 10_000
#: Base rules (fixed values of the contract).
BASE_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def count(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        # most texts repeat nothing, which a set of the hashes tells
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(ordered, marked), covered))

    return F.when(F.size(ws) < WINDOW + 1, F.lit(0)).otherwise(let(windows, count)).cast("long")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two histograms given as arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t), F.lit(0.0)))


def features(docs: DataFrame) -> DataFrame:
    """Base counts and the two histograms (counts, the last of each being the rest) of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    vocabulary = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    split = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), text.alias("text"), words(text).alias("ws"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANKS[1:]}"))
    n_symbols = F.regexp_count("text", F.lit(CLASSES["symbol"])).cast("long")
    word_chars = F.length(F.array_join("ws", "")).cast("long")
    counts = [F.regexp_count("text", F.lit(c)).cast("long") for c in CLASSES.values()]
    found = F.filter(F.transform("ws", F.lower), lambda w: w.isin(vocabulary))
    each = let(found, lambda f: F.array(*[(F.size(f) - F.size(F.array_remove(f, w))).cast("long") for w in vocabulary]))
    return split.select(
        "doc_id", "lang", F.size("ws").cast("long").alias("n_words"), word_chars.alias("word_chars"), n_symbols.alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(F.col("ws")).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"), F.array(*counts).alias("classes"), each.alias("common"),
    )


def _shares(counts: Column, total: Column) -> Column:
    """Counts and what is left of the total, as shares."""
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(counts, F.array(F.greatest(rest, F.lit(0).cast("long")))), lambda x: x / F.greatest(total, F.lit(1).cast("long")))


def word_limits(measured: DataFrame):
    """Function of (language, band, words) to the largest word distance, from a table (lang, band, n_words, w) of the distances of texts to the reference of their own language.

    The limit is a fence above the quartiles, which junk does not move while it is under a quarter. A text of n words has a distance near a multiple of 1 / sqrt(n)
    to its language, so bands with few texts take the fence of w * sqrt(n) over the language, and languages with few that over all.
    """
    steps = {"w": F.round(F.col("w") * STEPS), "s": F.round(F.col("w") * F.sqrt("n_words") * (STEPS // 10))}
    quartiles = [F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias(k) for k, v in steps.items()]
    fence = lambda q, unit: (q[1] + FENCE * (q[1] - q[0])) / unit
    # a row for each language and length band reaches the driver
    rows = measured.where("w is not null").groupingSets([["lang", "band"], ["lang"], []], "lang", "band").agg(F.count("*").alias("n"), *quartiles).collect()
    enough = {(r.lang, r.band): r for r in rows if r.n >= LEAST_BAND}

    def limit(lang: str, band: Column, n: Column) -> Column:
        over = enough.get((lang, None)) or enough.get((None, None))
        out = fence(over.s, STEPS // 10) / F.sqrt(n) if over else F.lit(MOST_WORD_DISTANCE)
        for (own, b), r in enough.items():
            if own == lang and b is not None:
                out = F.when(band == b, F.lit(fence(r.w, STEPS))).otherwise(out)
        return out

    return limit


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; also nearest_lang, class_distance, word_distance (null where not compared).

    base_failed: fewer than BASE_WORDS words, or over REPEAT_PERCENT percent of the words in repeated windows. Texts that pass and have LEAST_WORDS words are compared with
    the reference histograms of the languages of COMMON_WORDS (sums over all documents labelled so that pass the base rules): they are kept if for some language both Jensen-Shannon
    distances are within limits: a fixed one for character classes, and for words one that the corpus gives by language and length (see word_limits). Shorter ones, and all if no reference could be made, are kept on the base rules alone.

    Null text: no words, so it fails. Null ids or languages and repeated rows are judged like others. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    f = scratch.keep(features(docs))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    width = len({w for ws in COMMON_WORDS.values() for w in ws})
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(width)]
    # at most one row for each language of COMMON_WORDS reaches the driver
    made = f.where(~failed & F.col("lang").isin(sorted(COMMON_WORDS))).groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words"), *sums).orderBy("lang").collect()
    share = lambda xs, total: F.array(*[F.lit(x / total) for x in [*xs, max(total - sum(xs), 0)]])
    classes, common = _shares(F.col("classes"), F.col("n_chars")), _shares(F.col("common"), F.col("n_words"))
    found = []
    for r in made:
        c = distance(classes, share([r[f"c{i}"] for i in range(len(CLASSES))], max(r.chars, 1)))
        w = distance(common, share([r[f"w{i}"] for i in range(width)], max(r.words, 1)))
        found.append((r.lang, c, w))
    base = f.withColumn("base_failed", failed).withColumn("band", F.length(F.bin("n_words")))
    judged = ~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS)
    best = F.lit(None).cast("struct<worst:double,lang:string,c:double,w:double>")
    if found:
        own = F.coalesce(*[F.when(F.col("lang") == lang, w) for lang, _, w in found])
        limit = word_limits(base.where(judged).select("lang", "band", "n_words", own.alias("w")))
        compared = [F.struct(F.greatest(c / MOST_CLASS_DISTANCE, w / limit(lang, F.col("band"), F.col("n_words"))).alias("worst"), F.lit(lang).alias("lang"), c.alias("c"), w.alias("w")) for lang, c, w in found]
        best = F.when(judged, F.array_min(F.array(*compared)))
    out = base.withColumn("best", best)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("best.worst") <= 1.0, F.lit(True))).alias("kept"),
        F.col("best.lang").alias("nearest_lang"), F.col("best.c").alias("class_distance"), F.col("best.w").alias("word_distance"),
    )
