import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import substring_dedup as S


def words(rng, n):
    return [rng.choice("bcdfghjklm") + rng.choice("aeiou") + str(rng.randrange(400)) for _ in range(n)]


def test_windows_are_those_of_the_definition():
    rng = np.random.RandomState(1)
    doc = np.repeat([0, 1, 2, 3], [40, 3, 25, 60])
    value = rng.randint(1, 50, len(doc)).astype(np.uint64)
    value = value * np.uint64(1000) + np.arange(len(doc), dtype=np.uint64)  # no ties
    for width in (2, 5, 10):
        want = set()
        for c in range(len(doc)):
            l = r = c
            while l > 0 and doc[l - 1] == doc[c] and value[l - 1] > value[c]:
                l -= 1
            while r + 1 < len(doc) and doc[r + 1] == doc[c] and value[r + 1] > value[c]:
                r += 1
            if r - l + 1 >= width:
                want.add((l, c, r))
        assert set(zip(*(x.tolist() for x in S.compact_windows(value, doc, width)))) == want


@pytest.fixture(scope="module")
def planted(make):
    rng = random.Random(4)
    rows, holders = [], {}
    for p in range(6):
        passage = words(rng, 52 + 20 * p)
        for k in range(2 + 3 * p):
            text = list(passage)
            if p % 2 and k:  # near copies: a few words differ
                for _ in range(len(text) // 60):
                    text[rng.randrange(len(text))] = "other"
            doc = words(rng, rng.randrange(0, 90)) + text + words(rng, rng.randrange(0, 90))
            holders.setdefault(p, []).append(len(rows))
            rows.append((len(rows), " ".join(doc)))
    for _ in range(40):  # clean, but for a shared short line
        rows.append((len(rows), " ".join(words(rng, 120)) + "\none line that many texts share goes here again and again"))
    rows += [(900, ""), (901, None), (None, rows[0][1]), (902, "short text")]
    rng.shuffle(rows)
    return rows, holders, make(rows)


def test_planted_passages_are_found_and_clean_texts_left_alone(planted):
    rows, holders, docs = planted
    text = dict(rows)
    found = S.repeated_passages(docs).collect()
    links = {(r.source_id, r.doc_id) for r in found}
    seen = {x for pair in links for x in pair}
    assert all(r.source_id < r.doc_id and r.similarity >= 0.75 for r in found)
    for ids in holders.values():
        group = {ids[0]}
        for _ in ids:
            group |= {x for pair in links if group & set(pair) for x in pair}
        assert set(ids) <= group
    assert seen == {x for ids in holders.values() for x in ids}
    for r in found:
        a = text[r.source_id].split()[r.source_start_word : r.source_start_word + r.source_n_words]
        b = text[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
        assert len(a) >= 45 and len(b) >= 45 and len(set(a) & set(b)) > 0.8 * len(set(b))


def test_drop_keeps_the_first_copy(planted):
    rows, holders, docs = planted
    kept = {r.doc_id: r for r in S.drop_repeated_passages(docs).collect()}
    text = dict(rows)
    for ids in holders.values():
        assert kept[min(ids)].text == text[min(ids)]
        for i in ids[1:]:
            assert i not in kept or len(kept[i].text.split()) <= len(text[i].split()) - 45
            assert i not in kept or kept[i].n_chars == len(kept[i].text)
    clean = set(text) - {x for ids in holders.values() for x in ids}
    assert all(kept[i].text == text[i] for i in clean)


def test_exact_copies_and_repeated_rows(make):
    long = " ".join(words(random.Random(9), 200))
    docs = make([(1, long), (2, long), (3, long), (3, long), (4, "x " * 80)])
    assert {(r.source_id, r.doc_id) for r in S.repeated_passages(docs).collect()} == {(1, 2), (1, 3)}
    assert sorted(r.doc_id for r in S.drop_repeated_passages(docs).collect()) == [1, 4]


def test_empty_table(make):
    assert S.repeated_passages(make([])).count() == 0
    assert S.drop_repeated_passages(make([])).count() == 0


def test_a_word_left_out_on_another_alignment_of_the_pair():
    rng = random.Random(3)
    exact, near = words(rng, 60), words(rng, 80)
    u, v = (np.array([zlib.crc32(w.encode()) for w in x], np.uint32).tobytes() for x in (near, near[:40] + near[41:] + ["end"]))
    same = np.array([zlib.crc32(w.encode()) for w in exact], np.uint32).tobytes()
    rows = [(1, 2, 5, 10, same, same), (1, 2, 9, 200, u, v)]
    found = []
    for order in (rows, rows[::-1], rows[1:]):
        cols = [pa.array(c, t) for c, t in zip(zip(*order), [*[pa.int64()] * 4, *[pa.binary()] * 2])]
        batch = pa.RecordBatch.from_arrays(cols, ["a", "b", "diag", "lo", "x", "y"])
        found.append({(r["start_word"], r["source_start_word"]) for b in S._verify(iter([batch])) for r in b.to_pylist()})
    assert (209, 200) in found[2] and found[0] == found[1] == {(15, 10)} | found[2]


def _left(rows, found):
    """Runs of 50 words that an earlier document holds too and no row covers, by brute force."""
    first, missed, covered = {}, [], {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    for i, text in sorted(rows):
        w = text.split()
        for s in range(len(w) - S.WORDS + 1):
            if first.setdefault(tuple(w[s : s + S.WORDS]), i) != i and not covered.get(i, set()).issuperset(range(s, s + S.WORDS)):
                missed.append((i, s))
    return missed


def test_passages_made_of_frequent_lines_against_brute_force(make):
    rng = random.Random(12)
    lines = [words(rng, 32) for _ in range(12)]
    rows = []
    for i, line in enumerate(lines):  # each line alone comes first, and a second time before other words
        rows.append((i, " ".join(words(rng, 40) + line + words(rng, 40) + line + words(rng, 40))))
    for p in range(12):  # two lines in an order of their own, in three documents
        passage = sum(rng.sample(lines, 2), [])
        rows += [(100 + 3 * p + k, " ".join(words(rng, rng.randrange(60)) + passage + words(rng, rng.randrange(60)))) for k in range(3)]
    twice = sum(rng.sample(lines, 2), [])  # the passage at a document's second place of its lines
    rows += [(300, " ".join(sum(lines, []) + words(rng, 50) + twice)), (301, " ".join(words(rng, 30) + twice))]
    found = S.repeated_passages(make(rows)).collect()
    assert _left(rows, found) == []
    text = dict(rows)
    for r in found:
        a, b = (text[i].split()[s : s + n] for i, s, n in ((r.source_id, r.source_start_word, r.source_n_words), (r.doc_id, r.start_word, r.n_words)))
        assert r.source_id < r.doc_id and len(set(a) & set(b)) > 0.75 * len(set(b))


def test_keys_of_three_windows_are_open_whatever_the_batches():
    rows = [(3, 1, d, c, 0, 60) for d, c in ((1, 5), (2, 5))] + [(5, 1, 2, 5, 0, 60), (5, 2, 1, 5, 0, 60), (5, 2, 2, 9, 0, 60)]
    rows += [(7, 1, 4, c, 0, 60) for c in (5, 6, 7)] + [(8, x, x, 5, 0, 60) for x in range(4)]
    types = [pa.int64()] * 3 + [pa.int32()] * 3
    for size in (len(rows), 1, 2, 3):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), types)], list("kxdclr")) for i in range(0, len(rows), size)]
        got = {r["a"] for b in S._stars(iter(batches)) for r in b.to_pylist() if r["b"] is None}
        assert 5 in got and not got & {7, 8}


def test_columns_of_any_name_and_repeated_ids(spark):
    rng = random.Random(21)
    passage = " ".join(words(rng, 80))
    rows = [(1, passage + " a b c"), (2, "z " + passage + " tail end"), (2, "zz other text " * 3), (3, None), (None, passage)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "k", 5, 6) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, spans string, row_id int, least_text int")
    got = S.drop_repeated_passages(docs)
    assert got.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(1, passage + " a b c"), (2, "z  tail end"), (2, "zz other text " * 3), (3, None), (None, passage)], key=str
    )


def _shingled(words):
    return [tuple(words[i : i + S.SHINGLE]) for i in range(len(words) - S.SHINGLE + 1)]


@pytest.mark.parametrize("group", [1024, 8])
def test_near_copies_of_frequent_phrases_against_brute_force(make, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group, raising=False)  # a small one: groups are dealt into blocks
    rng = random.Random(31)
    phrases, texts = [words(rng, 38) for _ in range(3)], []
    for p in range(3):  # the phrase alone comes first, in several texts
        texts += [words(rng, 30) + phrases[p] + words(rng, 30) for _ in range(5)]
    for p in range(12):  # then near copies around it: words changed, added, left out
        passage = words(rng, 8) + phrases[p % 3] + words(rng, 8)
        for k in range(4):
            mine, at = list(passage), rng.choice([2, 5, 7, 26, 27, 46, 48, 51])
            mine[at : at + (k != 1)] = [[mine[at]], ["added"], ["other"], []][k]
            texts.append(words(rng, rng.randrange(30)) + mine + words(rng, rng.randrange(30)))
    halves = words(rng, 30), words(rng, 30)
    texts += [halves[0] + halves[1], words(rng, 9) + halves[1] + halves[0]]
    found = S.repeated_passages(make([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()
    covered, group_of = {}, list(range(len(texts)))
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
        old, new = group_of[r.doc_id], group_of[r.source_id]
        group_of = [new if g == old else g for g in group_of]
    runs = [[set(_shingled(t[s : s + S.WORDS])) for s in range(len(t) - S.WORDS + 1)] for t in texts]
    matches, missed = 0, []
    for b in range(len(texts)):
        for a in range(b):
            for s, y in enumerate(runs[b]):
                if any(100 * len(x & y) >= S.NUM * len(x | y) for x in runs[a]):
                    matches += 1
                    # First and last shingles that are not shared are no part of the passage.
                    inner = range(s + S.SHINGLE, s + S.WORDS - S.SHINGLE)
                    if group_of[a] != group_of[b] or not covered.get(b, set()).issuperset(inner):
                        missed.append((a, b, s))
    assert matches > 400 and missed == []


@pytest.mark.parametrize("group", [1 << 14, 64])
def test_a_line_repeated_on_and_on_is_covered_and_connected(make, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rng = random.Random(17)
    rows = []
    for i in range(60):  # stretches of 50 to 118 words between others, some with a word changed inside
        line = ["is", "one."] * rng.randrange(25, 60)
        if i % 5 == 4:
            line[rng.randrange(22, len(line) - 22)] = "changed"
        rows.append((i, " ".join(words(rng, rng.randrange(20, 60)) + line + words(rng, rng.randrange(20, 60)))))
    found = S.repeated_passages(make(rows)).collect()
    assert _left(rows, found) == []
    group_of = list(range(60))
    for r in found:
        old, new = group_of[r.doc_id], group_of[r.source_id]
        group_of = [new if g == old else g for g in group_of]
    assert len(set(group_of)) == 1


def test_copies_between_copies_of_one_document_are_left_out_and_stay_covered():
    places = [*range(100, 700, 2), 900, 1000, 1003]
    rows = [(9, 1, 1, 200, 155, 245)] + [(9, 1, 2, c, c - 45, c + 45) for c in places]
    types = [pa.int64()] * 3 + [pa.int32()] * 3
    for size in (len(rows), 100, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), types)], list("kxdclr")) for i in range(0, len(rows), size)]
        got = [r for b in S._stars(iter(batches)) for r in b.to_pylist() if r["b"] is not None]
        covered = {x for r in got for x in range(r["lo"] + r["diag"], r["hi"] + r["diag"] + 1)}
        assert covered == {x for c in places for x in range(c - 45, c + 46)}
        assert size < 100 or len(got) <= 36
