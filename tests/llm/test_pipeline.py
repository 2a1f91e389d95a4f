import random

import corpus_pipeline
import pytest

from graphloom.llm import source_mix as M

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, row_id string, spans string, position int, words int, doc string, first_id int, block int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(120)) for _ in range(6)]
    texts = [*base, base[0], base[1] + " more", base[2].replace(" ", "\n", 3), None, "", "12 34", " ".join(base[3].split()[:70]) + " " + base[4][::-1]]
    rows = [(i, t, "en", rng.choice(["s", "t", None]), len(t or ""), "x", "y", "z", "w", 1, 2, "v", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_in_a_row_keep_columns_and_clean_documents(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "jaccard_join", "substring_dedup", "source_mix", "byte_bpe"]
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").checkpoint()
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        assert all(len(r.text) == r.n_chars and r.words == 2 and r.shard == "y" for r in now.collect())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert kept["language_id"] == {i: t for i, t in text.items() if i not in (9, 10, 11)}
    assert kept["jaccard_join"] == {i: text[i] for i in (0, 1, 2, 3, 4, 5, 12)}
    assert set(kept["substring_dedup"]) == {0, 1, 2, 3, 4, 5, 12}
    assert kept["substring_dedup"][12].split() == text[4][::-1].split()
    for i, t in kept["source_mix"].items():  # whole texts, or their first words
        assert kept["substring_dedup"][i].startswith(t)
    last = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert last.count() == now.count()


def test_mixed_documents_hold_the_words_that_the_mix_takes(spark, make):
    rows = [(i, f"w{i} " * 100, s) for i, s in enumerate(["a", "a", "a", "b", "b", None])]
    mixed = [(r.doc_id, len(r.text.split())) for r in M.mixed_documents(make(rows)).collect()]
    taken = {r.doc_id: r.taken for r in M.mixed_words(make(rows)).collect()}
    got = {}
    for d, n in mixed:
        got[d] = got.get(d, 0) + n
    assert got == {d: n for d, n in taken.items() if n} and abs(sum(got.values()) - 900) <= 1.5  # half a word a source


def test_mix_of_empty_and_blank_tables(make):
    assert M.mixed_documents(make([])).count() == 0
    assert M.mixed_documents(make([(1, " \n"), (2, None)])).count() == 0
    assert M.mix(make([(1, "")])).count() == 0
