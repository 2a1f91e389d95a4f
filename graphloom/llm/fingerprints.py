"""Document fingerprints by one-permutation MinHash, in built-in functions.

Each distinct shingle is hashed once; the top bits of the hash name a bin and a
bin keeps its least hash. An empty bin copies the bin that comes first in an
order of its own (a few probes, then the bins by hash), the same order for every
document, so two documents fill it alike with the probability of their Jaccard
similarity. Four bits of a hash of each bin's value are kept, packed in 64-bit words; the
chance agreement of 1/16 is taken out of the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import materialize
from .sqltext import let, runs, words

SHINGLE = 5
BINS, BITS = 256, 4
_LOW_BITS = 55  # of a 63-bit hash; the 8 above name the bin
_LOW = (1 << _LOW_BITS) - 1
PROBES = 6
_PACKED = BINS * BITS // 64


def _probe(d: Column, i: Column, n: int) -> Column:
    at = F.pmod(F.xxhash64(i, F.lit(n)), F.lit(BINS)).cast("int")
    return let(F.get(d, at), lambda x: F.when(x.bitwiseAND(_LOW) != _LOW, x))


def _densified(d: Column) -> Column:
    """The bins without gaps; an array of nulls where every bin is empty."""
    filled = F.filter(d, lambda x: x.bitwiseAND(_LOW) != _LOW)
    return let(
        filled,
        lambda full: F.transform(
            d,
            lambda x, i: F.when(x.bitwiseAND(_LOW) != _LOW, x).otherwise(
                F.coalesce(
                    *(_probe(d, i, n) for n in range(PROBES)),
                    F.array_min(F.transform(full, lambda y: F.struct(F.xxhash64(i, F.shiftright(y, _LOW_BITS)).alias("h"), y.alias("y"))))["y"],
                )
            ),
        ),
    )


def packed(text: Column, k: int = SHINGLE) -> Column:
    """array<bigint> of BINS * BITS / 64 words; null for a text without words."""
    ends = F.expr(f"transform(sequence(0, {BINS - 1}), b -> (shiftleft(cast(b as bigint), {_LOW_BITS}) | {_LOW}L))")
    hashes = F.transform(runs(words(F.lower(text)), k, whole=True), lambda h: h.bitwiseAND((1 << 63) - 1))

    def bins(h: Column) -> Column:
        # Each bin's end mark is its greatest value: it is the bin's least only where the bin is empty.
        in_order = F.sort_array(F.concat(h, ends))
        return let(
            in_order,
            lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _LOW_BITS) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), _LOW_BITS))),
        )

    def pack(d: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(_PACKED - 1)),
            lambda j: F.aggregate(
                F.slice(d, j * (64 // BITS) + 1, 64 // BITS), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND((1 << BITS) - 1))
            ),
        )

    def marks(d: Column) -> Column:
        # A hash of value and bin: where many bins share a value, they don't agree by chance all at once.
        return F.transform(d, lambda x, i: F.xxhash64(x, i))

    return let(hashes, lambda h: F.when(F.size(h) > 0, let(marks(let(bins(h), _densified)), pack)))


def as_text(fp: Column) -> Column:
    """The fingerprint in hexadecimal; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1; texts without words are alike."""
    ones = int("1" * (64 // BITS), 16)

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)  # a bin differs where one of its four bits does
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(ones)))

    missed = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), ((1 - missed / F.lit(float(BINS))) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


#: Quantiles of doc_id that bound its ranges, and ranges for each shuffle partition.
QUANTILES, RANGES = 512, 16


def ranged(known: DataFrame) -> DataFrame:
    """``known`` with part: ranges of doc_id with about as many rows each, ascending, far more than partitions.

    Up to QUANTILES bounds come from quantiles; where more ranges are wanted,
    each of those is divided evenly.
    """
    wanted = RANGES * int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, each = min(QUANTILES, wanted), -(-wanted // QUANTILES)
    found = known.agg(F.percentile_approx("doc_id", [i / q for i in range(q + 1)], F.lit(10_000)).alias("cuts"), F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).first()
    inner = sorted(set(found.cuts or []) - {found.x})
    bounds = [found.x or 0, *inner]
    ends = [*inner, (found.y or 0) + 1]
    nth = F.size(F.filter(F.lit(bounds), lambda c: c <= F.col("doc_id"))) - 1
    at = lambda values: F.element_at(F.lit(values), nth + 1).cast("double")
    inside = F.least(F.lit(each - 1), F.floor((F.col("doc_id") - at(bounds)) / (at(ends) - at(bounds)) * each)) if each > 1 else F.lit(0)
    return known.withColumn("part", nth.cast("long") * each + inside)


def with_next(known: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, next_text): the next document in descending order of doc_id; after the last, the first.

    Of rows that share a doc_id the least text stands for it. The texts go
    through one exchange, by range of doc_id; a window runs within each range,
    and the greatest document of each range, alone, is looked up from the range above.
    """
    rows = ranged(known)
    ends = rows.groupBy("part").agg(F.max("doc_id").alias("most"))
    around = Window.orderBy("part")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row a range: the greatest id of the range below, for the lowest the greatest of all.
    ends = ends.select("part", F.coalesce(F.lag("most").over(around), F.max("most").over(whole)).alias("over"))
    ends = materialize(ends, "fingerprint-ranges")
    heads = known.join(ends.select(F.col("over").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("over_text"))
    heads = ends.join(heads, F.col("over") == F.col("doc_id")).select("part", "over", "over_text")
    up = Window.partitionBy("part").orderBy("doc_id", F.desc("text"))
    last = F.coalesce(F.lead("doc_id").over(up) != F.col("doc_id"), F.lit(True))  # the least text of its id
    before = F.last(F.when(F.col("last"), F.struct("doc_id", "text")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("last", last).withColumn("before", before).join(heads, "part")
    return rows.select("doc_id", "text", F.coalesce("before.doc_id", "over").alias("next_id"), F.coalesce("before.text", "over_text").alias("next_text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last third (rounded down) replaced by as many code
    points, or all, of the next document in descending order of doc_id. A null
    text is the empty one; its fingerprint is the empty string. Rows of one
    doc_id are each compared; where they differ, the least text stands for the id
    as another's next document. A null doc_id has the empty text as its next.
    An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(base.filter("doc_id is not null")).unionByName(
        base.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("long").alias("next_id"), F.lit("").alias("next_text"))
    )
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = both.select(
        "doc_id", "next_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"),
    )
    prints = materialize(
        edited.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("text")).alias("fp"), packed(F.col("edited")).alias("edited_fp")),
        "fingerprints",
    )
    nexts = prints.filter("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    return prints.join(nexts, "next_id", "left").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
