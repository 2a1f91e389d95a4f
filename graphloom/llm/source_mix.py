"""Mixing sources to target weights, in built-in functions.

1. *Targets.* The mix takes FACTOR times all words; sources share it by weight,
   none beyond CAP times its size, the excess shared anew.
2. *Draw.* A source gives whole passes over its documents, and of one more pass
   the documents that come first by hash, the last of them in part, so its words
   meet the target. A histogram of the hash finds where the pass ends; only the
   documents of one of its slots are put in order.
3. *Splitting tree.* The drawn copies of a source form blocks, by hash. A tree
   halves the shards; at each node the left half's number of blocks of each
   source is a multivariate hypergeometric draw from the node's, so the quotas
   of the children add up to those of the parent, and every source's blocks are
   used exactly once. A shard takes its quota from each source's blocks, which are
   numbered by hash, after those of the shards before it; it shuffles its rows
   by itself. No step sorts or gathers a whole source.
"""

from __future__ import annotations

import math
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import materialize, shared_dir
from .sqltext import BLANK, WORD

WEIGHTS, FACTOR, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Slots of the hash histogram of a source.
SLOTS = 4096
#: Words of a block, blocks of a shard.
BLOCK_WORDS, SHARD_BLOCKS = 50_000, 64
SEED = 20_240_607


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> dict[str | None, float]:
    """Words to take from each source: weights go round by name, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {name: w for (name, _), w in zip(order, cycle(weights))}
    size, left = dict(order), factor * sum(n for _, n in order)
    out, open_ = dict.fromkeys(size, 0.0), [name for name, n in order if n > 0]
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > cap * size[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap * size[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 52)) / float(1 << 52)


def _hypergeometric(n: str, rest: str, m: str, u: str) -> str:
    """SQL: successes of ``m`` draws from ``rest`` items of which ``n`` count, by inversion at ``u``.

    Weights run over eight standard deviations to either side of the mean; one
    follows from the one before it.
    """
    spread = f"(8 * sqrt({m} / {rest} * {n} * (1 - {n} / {rest}) * greatest(0.0D, ({rest} - {m}) / greatest(1.0D, {rest} - 1.0D))) + 8)"
    low = f"greatest(0L, {m} - ({rest} - {n}), cast(floor({m} / {rest} * {n} - {spread}) as bigint))"
    high = f"least({n}, {m}, cast(ceil({m} / {rest} * {n} + {spread}) as bigint))"
    ratio = f"(({n} - k) * 1.0D * ({m} - k) / ((k + 1.0D) * ({rest} - {n} - {m} + k + 1.0D)))"
    weigh = f"""aggregate(sequence({low}, {high}), named_struct('w', 1.0D, 't', 0.0D),
      (s, k) -> named_struct('w', if(k >= {high}, 0.0D, s.w * {ratio}), 't', s.t + s.w), s -> s.t)"""
    return f"""if({n} <= 0 or {m} <= 0 or {rest} <= 0, 0L, aggregate(sequence({low}, {high}),
      named_struct('w', 1.0D, 't', 0.0D, 'k', {low}, 'goal', {u} * {weigh}),
      (s, k) -> named_struct('w', if(k >= {high}, 0.0D, s.w * {ratio}), 't', s.t + s.w, 'k', if(s.t <= s.goal, k, s.k), 'goal', s.goal), s -> s.k))"""


_DRAW = f"""aggregate(sequence(0, size(counts) - 1),
  named_struct('left', array_repeat(0L, 0), 'm', taken, 'rest', aggregate(counts, 0L, (a, x) -> a + x)),
  (a, i) -> transform(array(named_struct('n', counts[i], 'u', pmod(xxhash64(lo, hi, i, {SEED}), 4503599627370496L) / 4503599627370496.0D)), d ->
    transform(array({_hypergeometric("d.n", "a.rest", "a.m", "d.u")}), k ->
      named_struct('left', concat(a.left, array(k)), 'm', a.m - k, 'rest', a.rest - d.n))[0])[0],
  a -> a.left)"""


def split_quotas(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, counts) from the one row of ``counts`` (counts array<bigint>, blocks of each source)."""
    shared_dir(counts.sparkSession)
    nodes = counts.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts")
    for _ in range(max(0, math.ceil(math.log2(max(1, shards))))):
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.expr("aggregate(counts, 0L, (a, x) -> a + x)")
        halves = nodes.withColumn("mid", middle).withColumn("taken", F.floor(total * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("bigint"))
        halves = halves.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(_DRAW)))
        parts = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "counts"))).otherwise(
            F.array(
                F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("counts")),
                F.struct(F.col("mid").alias("lo"), "hi", F.expr("zip_with(counts, left, (a, b) -> a - b)").alias("counts")),
            )
        )
        nodes = halves.select(F.explode(parts).alias("p")).select("p.*").repartition("lo").checkpoint()
    return nodes.select(F.col("lo").alias("shard"), "counts")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with row_id and size: its words, runs outside [\\x20\\x09-\\x0D]."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("row_id", F.monotonically_increasing_id())


def draw(rows: DataFrame, weights=WEIGHTS, factor: float = FACTOR, cap: float = CAP) -> DataFrame:
    """Adds source_size, target and taken to rows of (row_id, doc_id, source, size).

    ``rows`` must be a stored table. The driver holds one row for each source.
    A blank text takes part with size 0; null is a source of its own.
    """
    spark = rows.sparkSession
    totals = [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    wanted = targets(totals, weights, factor, cap)
    plan = []
    for name, n in totals:
        goal = math.floor(wanted[name] + 0.5)
        passes = min(goal // n, int(cap)) if n else 0
        plan.append((name, n, wanted[name], passes, goal - passes * n))
    plan_df = spark.createDataFrame(plan, "plan_source string, source_size long, target double, passes long, rest long")
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(SEED))).withColumn("slot", F.pmod("h", F.lit(SLOTS)).cast("int"))
    slots = hashed.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    # the slot in which a source's last pass ends; none where the pass takes nothing
    cut = slots.join(plan_df, same).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    cut = cut.select(F.col("plan_source").alias("cut_source"), F.col("slot").alias("cut_slot"), (F.col("rest") - F.col("before")).alias("room"))
    ends = plan_df.join(cut, F.col("plan_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    placed = hashed.join(ends, same).drop("plan_source")
    edge = placed.filter(F.col("slot") == F.col("cut_slot"))
    so_far = Window.partitionBy("source").orderBy("h", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("room") - F.coalesce(F.sum("size").over(so_far), F.lit(0)))))
    rest = placed.filter(F.coalesce(F.col("slot") != F.col("cut_slot"), F.lit(True)))
    rest = rest.withColumn("extra", F.when(F.col("slot") < F.col("cut_slot"), F.col("size")).otherwise(0))
    out = edge.unionByName(rest)
    return out.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra")).select(*rows.columns, "source_size", "target", "taken")


def copies(drawn: DataFrame) -> DataFrame:
    """(row_id, doc_id, source, copy, words): one row for each time that a row is taken; the last may be partial."""
    n = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = drawn.filter("taken > 0").select("row_id", "doc_id", "source", "size", "taken", F.explode(F.sequence(F.lit(1), n)).alias("copy"))
    words = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    return out.select("row_id", "doc_id", "source", "copy", words.alias("words"))


def shuffled(taken: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Adds shard and position to the copies: the order of the mix."""
    taken = materialize(taken, "mix-copies")
    per_source = taken.groupBy("source").agg(F.ceil(F.sum("words") / block_words).cast("long").alias("blocks"))
    per_source = materialize(per_source, "mix-sources")
    total = per_source.agg(F.sum("blocks")).first()[0]
    if not total:
        return taken.select("*", F.lit(0).alias("shard"), F.lit(0).alias("position"))
    shards = max(1, math.ceil(total / shard_blocks))
    listed = per_source.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "blocks"))).alias("all"))
    quotas = split_quotas(listed.select(F.col("all.blocks").alias("counts")), shards)
    names = listed.select(F.posexplode("all").alias("nth", "x")).select("nth", F.when(F.col("x.none"), None).otherwise(F.col("x.s")).alias("name"))
    each = quotas.select("shard", F.posexplode("counts").alias("nth", "n")).filter("n > 0")
    upto = Window.partitionBy("nth").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    owned = each.select("shard", "nth", F.explode(F.expr("sequence(offset, offset + n - 1)")).alias("block_no")).join(names, "nth").select("shard", "name", "block_no")
    blocks = per_source.select(F.col("source").alias("block_source"), "blocks")
    numbered = taken.join(blocks, F.col("source").eqNullSafe(F.col("block_source"))).drop("block_source")
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", F.lit(SEED + 1)), F.col("blocks"))).drop("blocks")
    placed = numbered.join(owned, F.col("source").eqNullSafe(F.col("name")) & (F.col("block") == F.col("block_no"))).drop("name", "block_no")
    by_hash = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(SEED + 2)), "doc_id", "row_id", "copy")
    return placed.withColumn("position", F.row_number().over(by_hash) - 1)


def mix(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, source, copy, words, block, shard, position) of the mix of (doc_id, text, source).

    Texts without a word are in no shard; repeated rows are told apart by row_id;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(measured(docs.select("doc_id", "text", "source")).select("row_id", "doc_id", "source", "size"), "mix-rows")
    return shuffled(copies(draw(rows)))


def mixed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    taken counts the words of all its copies in the mix. Reruns agree. A null
    text has size 0 and is never taken; repeated rows are rows of their own; an
    empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    rows = materialize(measured(base).select("row_id", "doc_id", "source", "size"), "mix-rows")
    drawn = materialize(draw(rows), "mix-drawn")
    sums = shuffled(copies(drawn)).groupBy("row_id").agg(F.sum("words").alias("mixed"))
    return drawn.join(sums, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("mixed", F.lit(0)).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(f"{BLANK}*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: a row for each copy, in the order of shards and places in them.

    A copy that the mix takes in part has its first words only, and its n_chars,
    where there is one, counted anew. Texts without a word are never taken; a
    null source is a source of its own; repeated rows are rows of their own; an
    empty table gives an empty result. All other columns stay as they are,
    whatever their names.
    """
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
    )
    rows = materialize(measured(whole).drop("text"), "mix-documents")
    drawn = draw(rows.select("row_id", "doc_id", "source", "size"))
    placed = materialize(shuffled(copies(drawn)).select("row_id", "shard", "position", "words"), "mix-placed")
    out = rows.join(placed, "row_id").repartitionByRange("shard").sortWithinPartitions("shard", "position")
    part = F.col("words") < F.col("size")
    text = F.when(part, first_words(F.col("doc.text").cast("string"), F.col("words"))).otherwise(F.col("doc.text"))
    made = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(part, F.char_length(text)).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
