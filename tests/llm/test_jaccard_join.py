import random

import numpy as np
import pytest

from graphloom.llm import jaccard_join
from graphloom.llm.components import connected_components
from graphloom.llm.jaccard_join import Bands, jaccard_components, keep_one_of_each


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(least.get(x, d), d)
    return {(d, len(s), least[x]) for (d, _), s, x in zip(rows, sets, label)}


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(n)]


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(4, 85, 100, 1), (5, 80, 100, 2), (2, 60, 100, 3)])
def test_components_are_those_of_all_pairs(spark, make, k, num, den, seed):
    rng = random.Random(seed)
    rows = [(1, ""), (2, None), (3, " \n\t"), (4, "One"), (5, "one "), (6, "a b c"), (7, "A  b\nc"), (8, "É b c"), (9, "é b c")]
    for n in (4, 5, 6, 7, 8, 9, 12, 30, 120, 400):
        for _ in range(3):
            base = words(rng, n)
            rows.append((len(rows) + 1, " ".join(base)))
            for _ in range(14):
                copy = list(base)
                for _ in range(rng.randrange(1 + max(1, n // 12))):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [copy[at], "x"]])
                rows.append((len(rows) + 1, " ".join(copy)))
    rng.shuffle(rows)
    got = {tuple(r) for r in jaccard_components(make(rows), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_many_near_copies_that_chain(spark, make):
    """A large group in which many members don't link with the pivot."""
    rng = random.Random(5)
    base, rows = words(rng, 60), []
    for i in range(150):
        if i % 3 == 0:
            base[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    assert {tuple(r) for r in jaccard_components(make(rows), 4, 85, 100).collect()} == brute(rows, 4, 85, 100)


def test_empty_table(spark, make):
    assert jaccard_components(make([]), 4, 85, 100).count() == 0


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1001, 1002)], "a long, b long")
    got = {(r.node, r.label) for r in connected_components(links).collect()}
    assert got == {(i, 0) for i in range(301)} | {(i, 1000) for i in (1000, 1001, 1002)}


def test_bands_do_not_depend_on_the_largest_set():
    few, many = Bands(5, 85, 100), Bands(100_000, 85, 100)
    for n in range(1, 6):
        band = np.searchsorted(few.ends, n, side="right") - 1
        for b in (band, band + 1):
            assert [few.parts[b], few.skip[b], few.ends[b]] == [many.parts[b], many.skip[b], many.ends[b]]


def test_large_cells_are_split_by_pivots_and_by_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 48)
    rng = random.Random(9)
    rows, base = [], words(rng, 80)
    for i in range(60):  # mostly linked with a pivot
        copy = list(base)
        copy[rng.randrange(80)] = f"m{i}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 120):  # a drifting chain, far from its start
        base[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(base)))
    assert {tuple(r) for r in jaccard_components(make(rows), 4, 85, 100).collect()} == brute(rows, 4, 85, 100)


def test_repeated_and_null_ids_and_a_long_text(spark, make):
    rng = random.Random(11)
    long = words(rng, 60_000)
    edited = long[:30_000] + ["other"] + long[30_001:]
    rows = [(1, "a b c d e"), (1, "f g h i j"), (None, "a b c d e"), (None, "q r s t u"), (5, " ".join(long)), (3, " ".join(edited))]
    got = sorted((tuple(r) for r in jaccard_components(make(rows), 4, 85, 100).collect()), key=str)
    n = [len({tuple(w[i : i + 4]) for i in range(len(w) - 3)}) for w in (long, edited)]
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None), (5, n[0], 3), (3, n[1], 3)], key=str)


def test_one_of_each_group_stays(spark, make):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (9, None), (8, ""), (None, "a b c d e f"), (None, None)]
    kept = keep_one_of_each(make(rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A b c d e f"), (9, None), (8, ""), (None, "a b c d e f"), (None, None)], key=str)
    assert kept.columns == make(rows).columns
