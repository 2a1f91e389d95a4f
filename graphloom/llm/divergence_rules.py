"""Quality rules by distribution divergence, in built-in functions.

A document's histograms of character classes and of common words are compared
with those of each language, by Jensen-Shannon distance; the nearest language
counts. The references are sums over all documents of a language. Short texts,
whose histograms say little, are judged by the base rules alone.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize
from .sqltext import BLANK, let, runs, words

#: Fewer words than this, and the histograms aren't judged.
MIN_WORDS = 40
#: Greatest distance of a kept document, the mean over both histograms.
MAX_DISTANCE = 0.25
MAX_LANGUAGES = 64

# Frequent function words of four languages, most frequent first.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on with as be by at are this from or an have not he his but they which you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
#: Ends of the rank groups of a language's common words.
GROUPS = (3, 10, 30)
CLASSES = ("lower", "upper", "digit", "mark", "sign")


def histograms(docs: DataFrame) -> DataFrame:
    """Base counts and histograms of each row, in one pass over the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    solid = F.regexp_replace("text", BLANK + "+", "")

    def left(s: Column, pattern: str) -> Column:
        return F.regexp_replace(s, pattern, "")

    def classes(s: Column) -> Column:
        steps = let(
            left(s, "[\\p{Ll}\\p{Lo}\\p{M}]+"),
            lambda a: let(left(a, "\\p{Lu}+"), lambda b: let(left(b, "\\p{N}+"), lambda c: let(left(c, "[.,;:!?'\"()-]+"), lambda d: F.array(
                F.char_length(s), F.char_length(a), F.char_length(b), F.char_length(c), F.char_length(d)
            )))),
        )
        return let(steps, lambda n: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: n[i] - F.coalesce(F.get(n, i + 1), F.lit(0))))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})

    def common(w: Column) -> Column:
        found = F.filter(F.transform(w, F.lower), lambda x: x.isin(every))
        parts = []
        for ws in COMMON_WORDS.values():
            for a, b in zip((0, *GROUPS), GROUPS):
                parts.append(lambda f, some=ws[a:b]: F.size(F.filter(f, lambda x: x.isin(some))))
        return let(found, lambda f: F.array(*(p(f) for p in parts)))

    def repeated(w: Column) -> Column:
        five = runs(w, 5, whole=False)

        def count(h: Column) -> Column:
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            twice = let(
                pairs,
                lambda p: F.filter(
                    p, lambda x, j: (F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))) | ((j > 0) & (F.get(p, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
                ),
            )
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(
                at, zero, lambda s, i: F.struct((i + 5).alias("end"), (s["n"] + 5 - F.greatest(F.lit(0), s["end"] - i)).alias("n")), lambda s: s["n"]
            )

        return let(five, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count(h)))

    shaped = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), common(w).alias("common"), repeated(w).alias("repeat")))
    lines_of = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = base.select(
        "doc_id", "lang", shaped.alias("w"), let(solid, classes).alias("classes"), F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"), lines_of.alias("n_dup_lines")
    )
    return out.select(
        "doc_id", "lang", F.col("w.n").cast("long").alias("n_words"), F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x).alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.repeat").cast("long").alias("n_repeat_words"), "classes", F.col("w.common").alias("common"),
    )


def references(counted: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Each language's histograms (character classes, common-word groups), over all its documents."""
    width = len(COMMON_WORDS) * len(GROUPS)
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(width)]
    rows = (
        counted.filter("lang is not null").groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).filter("n > 0")
        .orderBy(F.desc("n"), "lang").collect()
    )
    out = {}
    for r in rows:
        c = [r[f"c{i}"] for i in range(len(CLASSES))]
        ws = [r[f"w{i}"] for i in range(width)]
        out[r.lang] = ([x / max(1, sum(c)) for x in c], [x / r.n for x in ws] + [max(0.0, 1 - sum(ws) / r.n)])
    return out


def _distance(shares: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram of columns from one of numbers."""

    def part(p: Column, q: float) -> Column:
        m = (p + F.lit(q)) / 2
        a = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        return a + (F.lit(q) * (F.lit(math.log2(q)) - F.log2(m)) if q > 0 else F.lit(0.0))

    total = F.lit(0.0)
    for p, q in zip(shares, reference):
        total = total + part(p, q)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _nearest(classes: Column, groups: Column, reference: list[tuple[list[float], list[float]]]) -> Column:
    """The least mean of both distances, in a loop over any number of languages."""

    def far(shares: Column, of: Column) -> Column:
        def part(p: Column, q: Column) -> Column:
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * (F.log2(q) - F.log2(m))).otherwise(0.0)

        total = F.aggregate(F.zip_with(shares, of, part), F.lit(0.0), lambda a, x: a + x)
        return F.sqrt(F.greatest(F.lit(0.0), total / 2))

    rows = json.dumps([{"c": c, "w": w} for c, w in reference])
    each = F.from_json(F.lit(rows), "array<struct<c: array<double>, w: array<double>>>")
    return F.array_min(F.transform(each, lambda r: (far(classes, r["c"]) + far(groups, r["w"])) / 2))


def distance(reference: dict[str, tuple[list[float], list[float]]]) -> Column:
    """Mean of both distances to the nearest language; 0 without any language."""
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    n = F.greatest(F.col("n_words"), F.lit(1))
    classes = [F.col("classes")[i] / chars for i in range(len(CLASSES))]
    width = len(COMMON_WORDS) * len(GROUPS)
    groups = [F.least(F.col("common")[i] / n, F.lit(1.0)) for i in range(width)]
    rest = F.greatest(F.lit(0.0), 1 - sum(groups[1:], groups[0]))
    of = list(reference.values())
    each = [(_distance(classes, c) + _distance([*groups, rest], w)) / 2 for c, w in of[:MAX_LANGUAGES]]
    if of[MAX_LANGUAGES:]:
        each.append(_nearest(F.array(*classes), F.array(*groups, rest), of[MAX_LANGUAGES:]))
    return F.least(*each) if len(each) > 1 else each[0] if each else F.lit(0.0)


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base verdict and verdict of each row of (doc_id, text, lang).

    A null text counts as the empty one and fails the base rule of 10 words.
    lang chooses the documents that a reference sums over, and no document's
    verdict. Repeated rows stay; other columns are ignored; an empty table gives
    an empty result.
    """
    counted = materialize(histograms(docs), "quality-histograms")
    far = distance(references(counted))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        far.alias("distance"),
    ).withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < MIN_WORDS) | (F.col("distance") <= MAX_DISTANCE)))
