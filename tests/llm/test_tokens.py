import base64
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, orc_tokens

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
rng = random.Random(3)
TEXTS = [
    "The cat's  sat, ON\n\n the mat...", "", None, "Ünï côdé ÉÀ 12345  x y", "a" * 3000, "\n\n\nb \t\n c", "Ti wh, 東京 é It's don't",
    "".join(rng.choice("ab \n.'s1é") for _ in range(4000)), " " * 2000 + "x", "word " * 900, "<|endoftext|> x",
]


def as_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_orc_round_trip(spark, make):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[0]), (None, "z")]
    got = sorted(orc_tokens.encode_to_orc(make(rows), WORD).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(WORD)
    want = {}
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want[d] = (len(ids), as_crc(ids))
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert (r.n_tokens, r.ids_crc32) == want[r.doc_id] and r.start == at
        at += r.n_tokens


def test_start_follows_the_files_where_ids_repeat(spark, make, tmp_path):
    path = f"file://{tmp_path}/t"
    orc_tokens.write_tokens(make([(7, "b " * i) for i in (3, 1, 2)] + [(7, None), (2, "<|endoftext|>a")]), path, WORD)
    at, rows = 0, sorted(orc_tokens.token_index(spark, path).collect(), key=lambda r: r.start)
    stored = [(r.doc_id, list(r.ids)) for r in orc_tokens.read_tokens(spark, path).coalesce(1).collect()]
    assert [r.doc_id for r in rows] == [2, 7, 7, 7, 7] and [i for d, i in stored if d == 2] == [[49407, 320, 1]]
    for r in rows:
        assert r.start == at and (r.doc_id, r.ids_crc32) in {(d, as_crc(i)) for d, i in stored}
        at += r.n_tokens
    assert [r.n_tokens for r in rows[1:]] == [len(i) for d, i in stored if d == 7]


def test_a_vocabulary_that_joins_words_goes_through_the_library(make, tmp_path, monkeypatch):
    whole = Tokenizer.from_file(WORD)
    monkeypatch.setattr(orc_tokens._Chunks, "lookup", None)
    other = Tokenizer.from_str(whole.to_str())
    other.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    (tmp_path / "v.json").write_text(other.to_str())
    assert not orc_tokens._Chunks(other.to_str(), 1).by_chunk
    monkeypatch.undo()
    got = orc_tokens.encode_to_orc(make([(1, "The cat sat"), (2, None)]), str(tmp_path / "v.json")).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == {1: as_crc(other.encode("The cat sat", add_special_tokens=False).ids + [1]), 2: as_crc([1])}


def test_orc_prunes_and_reads_by_id(spark, make, tmp_path):
    path = f"file://{tmp_path}/t"
    orc_tokens.write_tokens(make([(i, f"text {i}") for i in range(50)]), path, WORD)
    assert [r.doc_id for r in orc_tokens.read_tokens(spark, path, [7]).collect()] == [7]
    plan = orc_tokens.read_tokens(spark, path, [7, 9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_orc_empty_table(spark, make):
    assert orc_tokens.encode_to_orc(make([]), WORD).count() == 0


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (40, 12), (7, 3), (100, 2)])
def test_byte_bpe_matches_the_library(spark, make, encoding, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (7, TEXTS[7]), (None, "q" * 50)]
    encoded = byte_bpe.encode(make(rows), RANKS, P.PATTERN, chunk, overlap)
    want = sorted((str(d), encoding.encode_ordinary(t or "")) for d, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()) == want
    back = byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in back) == sorted((str(d), t or "") for d, t in rows)


def test_byte_bpe_digest(spark, make, encoding):
    text = TEXTS[3]
    r = byte_bpe.digest(byte_bpe.encode(make([(1, text)]), RANKS, P.PATTERN), RANKS, P.PATTERN).first()
    ids = encoding.encode_ordinary(text)
    assert r.n_tokens == len(ids)
    assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_empty_table(spark, make):
    assert byte_bpe.encode(make([]), RANKS, P.PATTERN).count() == 0


def test_chunks_that_were_forgotten_are_encoded_anew(monkeypatch):
    texts = ["the cat, the Cat. über-x", "", "a cat the", "<|endoftext|> cat, x9 das é"] * 3
    text = Path(WORD).read_text()
    whole = Tokenizer.from_file(WORD)
    expected = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for room in (0, 200, 64 << 20):
        monkeypatch.setattr(orc_tokens, "CACHE_BYTES", room)
        monkeypatch.setattr(orc_tokens, "_encoders", {})
        run = orc_tokens._encode(type("Shared", (), {"value": text}), 1)
        batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(texts)]
        assert [ids for b in run(iter(batches)) for ids in b.column(2).to_pylist()] == expected
