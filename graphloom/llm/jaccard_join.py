"""N-gram Jaccard join in a metric space, exact.

A document is its set of distinct word shingles. The size of the symmetric
difference of two sets is a metric, and sets link only within a reach D that
follows from their sizes. Unrelated documents lie as far from every document
pivot as can be, so pivots alone would send each document to every region. The
space is therefore first split by coordinates, where triangle inequality does
prune, and pivots work from there on:

1. *Coordinates.* The shingles are dealt into K parts. Sets within D of each
   other differ in at most D parts, so they agree in K - D. Each set passes over
   its ``skip`` thinnest parts, K - D - 1 of them: of the parts in which a linked
   pair agrees, the fullest is among the others of both. Sets are banded by size,
   as D is; a set that may link with a larger one of the next band lies in both.
2. *Pivots and cells.* Of the sets that agree in a part, the one of the least id
   is the pivot, and all the others come to its cell. A linked pair lies in the
   cell of the pivot of the part that it shares. A cell of bounded size is joined
   exactly, on whole sets, in one task.
3. *Recursion.* A larger cell is split by further pivots, on stored distances: a
   member goes to its nearest pivot, and to each in its triangle-inequality
   window (nearest + 2 D). Members that link with a pivot are connected; of them
   only those stay in its region that lie within reach of a member that does not. Regions are split again until a task can hold each. Where a level does
   not shrink a cell, its members are dealt into blocks, and each two blocks meet.

Tasks give a spanning tree of each group that they connect, so a group of near
copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bloom import bloom_filter, may_hold
from .components import connected_components
from .scratch import drop, materialize, unused
from .textops import U64, distinct_by_doc, mix, word_slices
from .worker import tidy

#: Ratio of a size band's ends, and the share of further parts that each set passes over.
BAND_RATIO, SLACK = 1.4, 0.3
#: Members that a cell may have in one task, and bytes of their sets; larger cells are split.
CELL_ROWS, CELL_BYTES = 2048, 16 << 20
#: Pivots of one level of a large cell, as expected of a draw by hash.
PIVOTS = 8
#: Shingles of a cell that are counted at once.
COLUMNS = 2048

_SET_ID, _PART, _SEED = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


class Bands:
    """Size bands: lower ends, parts and parts passed over of each."""

    def __init__(self, largest: int, num: int, den: int):
        ends, beyond = [1], 0
        while beyond < 3:  # the largest set's band, the next one, and its end
            ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
            beyond += ends[-1] > largest
        self.ends = np.array(ends, np.int64)
        top = self.ends[1:] - 1
        reach = 2 * top * (den - num) // (den + num)
        self.skip = (SLACK * (reach + 1)).astype(np.int64)
        self.parts = reach + 1 + self.skip


def _sums(slot: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, U64)
    np.add.at(total, slot, mix(h))
    return total


def _regions(size: np.ndarray, h: np.ndarray, doc: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(region key, document): of every document with a shingle, the parts that it doesn't pass over."""
    bands = Bands(int(size.max(initial=1)), num, den)
    band = np.maximum(np.searchsorted(bands.ends, size, side="right") - 1, 0)
    keys, owners = [], []
    for step in (0, 1):
        b = band + step
        use = size > 0
        if step:  # it may link with a larger set of the next band
            use &= size * den >= num * bands.ends[b]
        live = use[doc]
        hh, dd = h[live], doc[live]
        parts = np.where(use, bands.parts[b], 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        slot = base[dd] + (((mix(hh ^ _SEED) >> U64(32)) * parts[dd].astype(U64)) >> U64(32)).astype(np.int64)
        total, count = _sums(slot, hh ^ _PART, base[-1]), np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(size)), parts)
        number = np.arange(base[-1]) - base[owner]
        # Thinnest first within each document, ties by number: the same order for both sets of a pair.
        order = np.argsort((owner << 40) + (np.minimum(count, 4095) << 28) + number, kind="stable")
        keep = np.empty(len(order), bool)
        keep[order] = np.arange(len(order)) - base[owner[order]] >= bands.skip[b][owner[order]]
        tag = mix((b[owner].astype(U64) << U64(40)) + number.astype(U64))
        keys.append(mix(total + tag)[keep])
        owners.append(owner[keep])
    return np.concatenate(keys), np.concatenate(owners)


def _set_ids(size: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(_sums(doc, h ^ _SET_ID, len(size)) + size.astype(U64)).view(np.int64)


_SKETCH = "doc_id long, n_shingles long, set_id long, regions array<long>"


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in word_slices(batch.column(1)):
                h, doc = distinct_by_doc(*words.shingles(k))
                size = np.bincount(doc, minlength=words.n_docs)
                sid = _set_ids(size, h, doc)
                # Copies have the same regions: of those in this slice one emits them.
                first = np.zeros(words.n_docs, bool)
                first[np.unique(sid, return_index=True)[1]] = True
                keep = first[doc]
                keys, owner = _regions(np.where(first, size, 0), h[keep], doc[keep], num, den)
                order = np.argsort(owner, kind="stable")
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words.n_docs))]).astype(np.int32),
                    pa.array(keys[order].view(np.int64)),
                )
                cols = [ids.slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(sid, mask=size == 0), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_id", "regions"])

    return tidy(run)


@tidy
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, set) of the sets beside the pivot, from rows (region, set) in order."""
    region = pivot = last = None
    for batch in batches:
        keys, sets = (c.to_numpy() for c in batch.columns)
        if not len(keys):
            continue
        new = np.concatenate([[keys[0] != region], keys[1:] != keys[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        pivots = np.where(start >= 0, sets[start], sets[0] if pivot is None else pivot)
        again = np.concatenate([[sets[0] == last], sets[1:] == sets[:-1]])
        keep = ~new & ~again & (sets != pivots)
        region, pivot, last = keys[-1], pivots[-1], sets[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pivots[keep]), pa.array(sets[keep])], ["cell", "set_id"])


def _sets(k: int, sets, docs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            there = np.asarray(ids.is_null()) | may_hold(docs.value, ids.fill_null(0).to_numpy())
            for _, _, words in word_slices(batch.column(1).filter(pa.array(there))):
                h, doc = distinct_by_doc(*words.shingles(k))
                size = np.bincount(doc, minlength=words.n_docs)
                ends = np.concatenate([[0], np.cumsum(size)])
                sid = _set_ids(size, h, doc)
                first = np.unique(sid, return_index=True)[1]
                first = first[(size[first] > 0) & may_hold(sets.value, sid[first])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[first]), pa.array([h[ends[i] : ends[i + 1]].tobytes() for i in first], pa.binary())], ["set_id", "members"]
                )

    return tidy(run)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets; each set holds distinct hashes."""
    n = len(sets)
    every, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(every)
    every, row = every[order], row[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]
    held = np.diff(np.append(np.flatnonzero(new), len(every)))  # sets that hold each hash
    several = held > 1
    row, held = row[np.repeat(several, held)], held[several]
    at = np.concatenate([[0], np.cumsum(held)])
    out = np.zeros((n, n), np.float32)
    for i in range(0, len(held), COLUMNS):
        part = held[i : i + COLUMNS]
        hits = np.zeros((n, len(part)), np.float32)
        hits[row[at[i] : at[i + len(part)]], np.repeat(np.arange(len(part)), part)] = 1
        out += hits @ hits.T
    return out.astype(np.int64)


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(i, j): stars over the groups that links within ``sets`` connect."""
    size = np.array([len(x) for x in sets], np.int64)
    common = common_counts(sets)
    linked = common * den >= (size[:, None] + size[None] - common) * num
    free, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if free[i]:
            free[i], edge = False, np.array([i])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(0) & free)
                free[edge] = False
                out.extend((i, j) for j in edge.tolist())
    return out


def _hashes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in column]


@tidy
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that agree in the first column, from rows in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        if held and key[0] != held[0].column(0)[0].as_py():
            yield pa.concat_batches(held)
            held = []
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for a, b in zip(at[:-1], at[1:]):
            yield pa.concat_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(at[-1]))
    if held:
        yield pa.concat_batches(held)


def _join_cells(num: int, den: int):
    """(a, b) of set ids, from whole cells: rows (sub, set_id, members) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches):
            ids = group.column(1).to_numpy()
            links = spanning_links(_hashes(group.column(2)), num, den) if len(ids) > 1 else []
            a += [ids[i] for i, _ in links]
            b += [ids[j] for _, j in links]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tidy(run)


_NEAR = "sub long, set_id long, members binary, j long, away long, core boolean"


def _by_pivots(num: int, den: int):
    """Rows (sub, salt, pivot, set_id, members) in order, pivots first: where each member goes.

    (…, j, away, core): the pivot, the distance from it, and whether they link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots = None, []
        for batch in batches:
            out = []
            for sub, salt, is_pivot, sid, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                mine = np.frombuffer(raw.as_buffer(), U64)
                if (sub, salt) != key:
                    key, pivots = (sub, salt), []
                if is_pivot:
                    pivots.append((sid, mine))
                    continue
                common = np.array([len(np.intersect1d(mine, p, assume_unique=True)) for _, p in pivots], np.int64)
                away = np.array([len(p) for _, p in pivots], np.int64) + len(mine) - 2 * common
                tied = common * den >= (away + common) * num
                for j in np.flatnonzero(away <= away.min() + 2 * (len(mine) * (den - num) // num)).tolist():
                    out.append((sub, sid, raw.as_py(), pivots[j][0], int(away[j]), bool(tied[j])))
            if out:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["sub", "set_id", "members", "j", "away", "core"])

    return tidy(run)


def _large(rows: DataFrame) -> DataFrame:
    """(sub, rows, times): cells with more than one task may hold, and how many times as much."""
    n = rows.groupBy("sub").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    times = F.greatest(F.ceil(F.col("rows") / CELL_ROWS), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    return n.withColumn("times", F.least(times, F.ceil(F.col("rows") / 4).cast("int"))).filter("times > 1").drop("bytes")


def _split(open_: DataFrame, level: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(smaller cells, links found) of cells of rows (sub, set_id, members, rows, times) that no task can hold."""
    drawn = F.pmod(F.xxhash64("set_id", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("rows") / PIVOTS))) == 0
    # Pivots go to each salt of their cell, before its members.
    pivots = open_.filter(drawn).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("after", F.lit(0))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(-1)), F.col("times")).cast("int")).withColumn("after", F.lit(1))
    stream = pivots.unionByName(salted).join(open_.filter(drawn).select("sub").distinct(), "sub", "left_semi")
    stream = stream.select("sub", "salt", (F.col("after") == 0).alias("pivot"), "set_id", "members", "after")
    stream = stream.repartition("sub", "salt").sortWithinPartitions("sub", "salt", "after").drop("after")
    near = materialize(stream.mapInArrow(_by_pivots(num, den), _NEAR), "jaccard-near")
    pieces = near.groupBy("sub", "j").agg(F.min(F.when(~F.col("core"), F.col("away"))).alias("edge")).filter("edge is not null")
    # Of those connected with a pivot, those within reach of another member go on; pieces without another are settled.
    reach = F.floor(F.octet_length("members") / 8 * (den - num) / num)
    on = near.join(pieces, ["sub", "j"]).filter(~F.col("core") | (F.col("away") + reach >= F.col("edge")))
    work = on.groupBy("sub", "j").count().groupBy("sub").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
    sizes = open_.join(near.select("sub").distinct(), "sub", "left_semi").select("sub", "rows").distinct().join(work, "sub", "left")
    kept = materialize(sizes.filter(F.coalesce("work", F.lit(0.0)) < 0.7 * F.col("rows") * F.col("rows")).select("sub"), "jaccard-kept")
    on = on.join(kept, "sub", "left_semi").select(F.xxhash64("sub", F.lit(level), "j").alias("sub"), "set_id", "members")
    # Each two blocks of a cell that did not shrink, in two thirds of a task's room.
    n = 3 * F.col("times")
    block = F.pmod(F.xxhash64("set_id", F.lit(-2)), n).cast("int")
    met = F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.least(x, block).alias("x"), F.greatest(x, block).alias("y")))
    blocks = open_.join(kept, "sub", "left_anti").withColumn("met", F.explode(met)).select(F.xxhash64("sub", F.lit(-3), "met").alias("sub"), "set_id", "members")
    return on.unionByName(blocks), near.filter("core").select(F.col("j").alias("a"), F.col("set_id").alias("b"))


def _links(sketch: DataFrame, known: DataFrame, base: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of set ids, of which the components are those of all links."""
    postings = sketch.select(F.explode("regions").alias("region"), "set_id")
    cells = postings.repartition("region").sortWithinPartitions("region", "set_id").mapInArrow(_cells, "cell long, set_id long").distinct()
    cells = materialize(cells, "jaccard-cells")
    drop(sketch)
    cells = cells.unionByName(cells.select("cell", F.col("cell").alias("set_id")).distinct())

    # The sets of the cells, and few others, are hashed again from the texts.
    context = base.sparkSession.sparkContext
    ids = cells.select("set_id").distinct()
    holders = known.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    holders = materialize(holders.join(ids, "set_id", "left_semi"), "jaccard-holders")
    of_sets, of_docs = (context.broadcast(bloom_filter(x)) for x in (holders.select("set_id"), holders.select("doc_id").filter("doc_id is not null")))
    sets = base.mapInArrow(_sets(k, of_sets, of_docs), "set_id long, members binary").dropDuplicates(["set_id"])

    sized = cells.join(holders.select("set_id", (F.col("n") * 8).alias("bytes")), "set_id").select(F.col("cell").alias("sub"), "set_id", "bytes")
    large = materialize(_large(sized), "jaccard-large")
    rows = cells.withColumnRenamed("cell", "sub").join(large, "sub", "left").join(sets, "set_id")
    found: list[DataFrame] = []

    def join_cells(some: DataFrame) -> None:
        some = some.select("sub", "set_id", "members").repartition("sub").sortWithinPartitions("sub", "set_id")
        found.append(materialize(some.mapInArrow(_join_cells(num, den), "a long, b long"), "jaccard-links"))

    join_cells(rows.filter("times is null"))
    level = 0
    while not large.isEmpty():
        if level > 24:
            raise RuntimeError("cells did not split")
        open_ = materialize(rows.filter("times > 1"), "jaccard-open")
        rows, links = _split(open_, level, num, den)
        found.append(links)
        rows = materialize(rows.withColumn("bytes", F.octet_length("members").cast("long")), "jaccard-pieces")
        large = materialize(_large(rows), "jaccard-large")
        rows = rows.join(large, "sub", "left")
        join_cells(rows.filter("times is null"))
        level += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Documents link when ``den * intersection >= num * union`` of their sets of
    distinct ``k``-word shingles; component_id is the smallest doc_id reachable.
    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text of
    fewer than ``k`` words has its whole sequence as one shingle. A null, empty
    or blank text has no shingle, links with nothing and is its own component.
    Repeated texts form one class. Rows that share a doc_id are each compared by
    their own text. Other columns of ``docs`` are ignored; an empty table gives
    an empty result. A null doc_id is kept, and is never the smallest where the
    component has another.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(base.mapInArrow(_sketch(k, num, den), _SKETCH), "jaccard-sketch")
    known = materialize(sketch.select("doc_id", "n_shingles", "set_id"), "jaccard-known")
    labels = connected_components(_links(sketch, known, base, k, num, den)).checkpoint()

    classes = known.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "class_id", F.coalesce("label", "set_id").alias("label")
    )
    least = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "label").select("set_id", "component_id")
    with_text = known.filter("set_id is not null").join(named, "set_id", "left").select("doc_id", "n_shingles", "component_id")
    return with_text.unionByName(known.filter("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns.

    Of repeated rows with that doc_id one stays; rows without a doc_id all stay.
    """
    name = unused(docs, "first_id")
    first = jaccard_components(docs, k, num, den).filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col("doc_id").cast("long") == F.col(name)).drop(name).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null"))
