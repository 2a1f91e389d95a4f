import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from graphloom.llm import divergence_rules as D
from graphloom.llm import fingerprints as FP
from graphloom.llm import language_id as L
from graphloom.llm import quality_rules as Q
from graphloom.llm import source_mix as M
from graphloom.llm import toxicity as X
from graphloom.llm.textops import NOT_ALNUM, distinct_by_doc, word_slices


def brute_word(word, pieces, p):
    text = bytes([L.MARK]) + word
    a = [1.0] + [0.0] * len(text)
    for i in range(len(text)):
        for k, piece in enumerate(pieces):
            if text[i : i + len(piece)] == piece:
                a[i + len(piece)] += a[i] * p[k]
    return np.log(a[-1])


def test_forward_sums_all_segmentations():
    model = L.fit({"a": ["the cat the hat that"]}, [b" t", b"th", b"he", b"the", b" th", b"at", b" the", b"hat"])
    data = np.frombuffer(b"thehat that at", np.uint8)
    got = model.words(data, np.array([0, 7, 12]), np.array([6, 11, 14]))[:, 0]
    want = [brute_word(w, model.trie.pieces, model.p[:, 0]) for w in (b"thehat", b"that", b"at")]
    assert np.allclose(got, want)


def test_language_id(make):
    en, fr = "the cat sat on the mat and the dog ran ", "le chat est sur la table et le chien court "
    rows = [(i, (en if i % 2 else fr) * (1 + i % 5), "s", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "s", "en"), (101, "", "s", None), (102, "12 34 !!", "s", "en"), (103, en * 3000, "s", None)]
    docs = make(rows)
    got = {r.doc_id: r for r in L.identify(docs, P.path("piece_bpe_32k.model")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    kept = L.keep_identified(docs, P.path("piece_bpe_32k.model"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(60), 103}
    assert L.identify(make([]), P.path("piece_bpe_32k.model")).count() == 0


def test_toxicity_and_quality(spark, make):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic, good = i % 8 == 0, i % 3 > 0
        if toxic:
            words[rng.randrange(60)] = "vileword"
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (902, "x" * 200_000)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {i: (q, t) for i, q, t in labels}
    tox = {r.doc_id: r for r in X.detect(make(rows), marks).collect()}
    assert np.mean([tox[i].predicted == want[i][1] for i in want if tox[i].held_out]) > 0.97
    assert tox[900].predicted == tox[901].predicted == 0 and 0 <= tox[902].score <= 1
    quality = {r.doc_id: r for r in Q.grade(make(rows), marks).collect()}
    assert np.mean([quality[i].predicted == want[i][0] for i in want if quality[i].held_out]) > 0.97
    assert X.detect(make([]), marks).count() == 0 and Q.grade(make(rows[:3]), marks.limit(0)).count() == 3


def test_mix_meets_targets(spark, make):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a", "b", "c", None])) for i in range(300)] + [(7, "x y z", "a"), (400, None, "d")]
    got = M.mixed_words(make(rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault((r.target, r.source_size), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (t, _), v in taken.items())
    assert sorted(map(str, got)) == sorted(map(str, M.mixed_words(make(rows)).collect()))
    assert M.mixed_words(make([])).count() == 0
    t = M.targets([("a", 10), ("b", 1000), (None, 10)])
    assert t["a"] == 20 and t[None] <= 20 and abs(sum(t.values()) - 1530) < 1e-9


def test_splitting_tree_keeps_quotas(spark):
    counts = [500, 20, 7, 0, 300]
    rows = M.split_quotas(spark.createDataFrame([(counts,)], "counts array<bigint>"), 7).collect()
    assert sorted(r.shard for r in rows) == list(range(7))
    assert [sum(r.counts[i] for r in rows) for i in range(5)] == counts
    assert {sum(r.counts) for r in rows} == {118, 119}


def test_fingerprints_estimate_jaccard(make):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 400])))) for i in range(60)] + [(60, ""), (61, None), (62, "Ünï é")]
    text = {i: t or "" for i, t in rows}
    got = {r.doc_id: r for r in FP.compare_with_edits(make(rows)).collect()}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    order, errors, nexts = sorted(text, reverse=True), [], []
    for i, d in enumerate(order):
        nxt, n = text[order[(i + 1) % len(order)]], len(text[d])
        a, b = shingles(text[d]), shingles(text[d][: n - n // 3] + nxt[: n // 3])
        errors.append(got[d].near_edited - (len(a & b) / len(a | b) if a | b else 1))
        c = shingles(nxt)
        nexts.append(got[d].near_next - (len(a & c) / len(a | c) if a | c else 1))
        edited = text[d][: n - n // 3] + nxt[: n // 3]
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    assert np.sqrt(np.mean(np.square(nexts))) < 0.08
    assert np.sqrt(np.mean(np.square(errors))) < 0.08
    assert got[60].fingerprint == got[61].fingerprint == ""


@pytest.mark.parametrize(("quantiles", "ranges"), [(512, 4), (2, 3), (3, 40)])
def test_next_documents_across_ranges_and_repeated_ids(make, monkeypatch, quantiles, ranges):
    monkeypatch.setattr(FP, "QUANTILES", quantiles)
    monkeypatch.setattr(FP, "RANGES", ranges)
    rng = random.Random(quantiles)
    rows = [(rng.choice([-5, 7, 8, 9, 1000, 10**12, rng.randrange(500)]), f"{i} é{i} " * rng.randrange(4)) for i in range(90)]
    least = {}
    for d, t in rows:
        least[d] = min(least.get(d, t), t, key=str.encode)
    order = sorted(least, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    got = FP.with_next(make(rows).select("doc_id", "text")).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, t, after[d], least[after[d]]) for d, t in rows)


def test_fingerprints_of_few_rows(make):
    assert FP.compare_with_edits(make([])).count() == 0
    (one,) = FP.compare_with_edits(make([(3, "abcdef")])).collect()
    assert (one.n_chars, one.edited_sha256, one.near_next) == (6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)
    twice = FP.compare_with_edits(make([(3, "a b c"), (3, "a b c"), (None, "a b c"), (4, None)])).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["3", "3", "4", "None"]
    assert len({r.fingerprint for r in twice if r.doc_id != 4}) == 1


def test_divergence_rules(make):
    rows = [(1, None), (2, "a b c"), (3, "x y z w v " * 20), (4, "one\ntwo\none\n \n\nthree four five six seven eight nine #$"), (5, " ".join(f"the{i} and" for i in range(90)))]
    got = {r.doc_id: r for r in D.judge(make(rows)).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[3].n_repeat_words == 100 and got[3].base_failed
    assert (got[4].n_dup_lines, got[4].n_symbols, got[4].n_words, got[4].n_repeat_words) == (1, 2, 11, 0)
    assert D.judge(make([])).count() == 0


def test_words_counted_on_the_cluster_are_those_of_fit(spark):
    rng = random.Random(5)
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(200)}" for _ in range(40)] + (["vileword"] if i % 4 == 0 else [])
        texts.append((i, i % 4 == 0, i % 3 > 0, " ".join(words)))
    texts += [(500, False, True, None), (501, True, False, "")]
    sample = spark.createDataFrame(texts, "doc_id long, p boolean, u boolean, text string").repartition(3)
    n_p, n_u = sum(t[1] for t in texts), sum(t[2] for t in texts)
    told = X._telling(sample, n_p, n_u)
    assert len(told)
    column = pa.array([t[3] for t in texts], pa.string())
    every = {}
    for a, b, words in word_slices(column, between=NOT_ALNUM):
        h, doc = distinct_by_doc(*X._features(words))
        every |= {texts[a + i][0]: h[doc == i] for i in range(b - a)}
    whole = X.fit([every[t[0]] for t in texts if t[1]], [every[t[0]] for t in texts if t[2]], 0.25)
    assert whole.words.tolist() == told.tolist()


def test_divergence_measures_against_every_language(make, monkeypatch):
    alphabets = ("abcdefgh", "ijklmnop", "0123456789", "АБВГДЕЖЗ")
    rng = random.Random(8)
    rows = [(10 * i + k, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(60 + 20 * i)), "s", f"l{i}") for i, a in enumerate(alphabets) for k in range(4)]
    docs = make(rows)
    want = {r.doc_id: (round(r.distance, 9), r.kept) for r in D.judge(docs).collect()}
    monkeypatch.setattr(D, "MAX_LANGUAGES", 1)
    assert {r.doc_id: (round(r.distance, 9), r.kept) for r in D.judge(docs).collect()} == want
