"""Encoding, decoding and the id files beside the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import bpe, dac
from tidewatch.llm.queries import QUERIES, VOCABULARY
from tidewatch.session import scratch_path

PATH = public_tokenizers.path(VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def wanted(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def test_automaton_encodes_and_decodes_like_the_library(codec):
    rng = random.Random(1)
    letters = "abcdehilmnorstu'"
    cases = ["", "''s don't I'LL x\x1c!y", "a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>", "aaaa" * 40, "é é ﬁ Å"]
    cases += ["Σίσυφος ΣΑΣ İı", "日本語 ١٢ Ⅷ½", "\x00\x01!!!???...\u2028x", "𝔘𝔫𝔦👍🏽"]
    cases += [" ".join("".join(rng.choices(letters, k=rng.randint(1, 24))) for _ in range(80)) for _ in range(30)]
    for text in cases:
        ids = np.frombuffer(codec.encode(text.encode()), "<i4").tolist()
        assert ids == wanted(text)
        assert codec.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_words_do_not_depend_on_what_was_remembered(codec, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 3)
    text = " ".join(f"word{i % 17} other{i}" for i in range(200))
    assert np.frombuffer(codec.encode(text.encode()), "<i4").tolist() == wanted(text)


def test_automaton_of_equal_halves_merges_from_the_left():
    names = ["a", "a</w>", "aa", "aaaa", "aaa</w>"]
    vocabulary = {s: i for i, s in enumerate(names)}
    own = bpe.MergeAutomaton(vocabulary, [("a", "a"), ("aa", "aa"), ("aa", "a</w>")], "</w>")
    assert own.encode([0, 0, 0, 0, 1]) == [3, 1]
    assert own.encode([0, 0, 1]) == [4]
    assert own.encode([0, 1]) == [0, 1]
    assert own.encode([]) == []


def test_encode_and_decode_of_hard_rows(spark, hard, nothing):
    coded = bpe.decode(bpe.encode(hard, PATH, ids="own"), PATH, "own", "back")
    assert coded.columns == [*hard.columns, "own", "back"]
    rows = coded.collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert r.own == wanted(r.text) and r.back == LIBRARY.decode(r.own, skip_special_tokens=False)
        assert (r.n_words, r.spans, r.ids, r.score) == (7, "x", [1], 2.5)
    assert bpe.decode(bpe.encode(nothing, PATH, ids="own"), PATH, "own", "back").count() == 0


def test_codes_give_any_id():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << k, n) for k, n in ((8, 5), (16, 3000), (20, 0), (24, 1777), (32, 100), (1, 0))]
    own, flat = dac.Segment.from_bytes(dac.Segment.build(docs).to_bytes()), np.concatenate(docs)
    assert [own.get(i) for i in range(len(flat))] == flat.tolist()
    assert all((own.document(k) == d).all() for k, d in enumerate(docs))
    assert (own.ids(100, 2500) == flat[100:2500]).all()
    with pytest.raises(IndexError):
        own.get(len(flat))
    with pytest.raises(ValueError):
        dac.Segment.from_bytes(b"something else")
    assert dac.Segment.from_bytes(dac.Segment.build([]).to_bytes()).n == 0


def test_files_hold_documents_in_order(spark, hard, nothing, monkeypatch):
    monkeypatch.setattr(dac, "SEGMENT_IDS", 40)
    path = scratch_path(spark, "dac")
    dac.write(hard, path, PATH)
    rows = sorted(dac.digests(spark, path).collect(), key=lambda r: r.start)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [key((r.doc_id,)) for r in rows] == sorted(key(r) for r in hard.select("doc_id").collect())
    texts = {}
    for r in hard.collect():
        crc = zlib.crc32(np.array([*wanted(r.text), 2], "<u4").tobytes())
        texts.setdefault(r.doc_id, []).append((len(wanted(r.text)) + 1, crc))
    at = 0
    for r in rows:
        assert r.start == at
        texts[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    empty = scratch_path(spark, "dac")
    dac.write(nothing, empty, PATH)
    assert dac.digests(spark, empty).count() == 0


def test_queries_equal_the_library(spark, sf_dir):
    import hashlib

    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    at = 0
    files = {r.doc_id: r for r in QUERIES["op2_dac"](spark, sf_dir).collect()}
    codes = {r.doc_id: r for r in QUERIES["op4_bpe"](spark, sf_dir).collect()}
    assert set(files) == set(codes) == set(documents)
    for i in sorted(documents):
        ids = wanted(documents[i])
        assert (files[i].start, files[i].n_tokens) == (at, len(ids) + 1)
        assert files[i].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
        at += len(ids) + 1
        assert codes[i].n_tokens == len(ids)
        assert codes[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        assert codes[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
