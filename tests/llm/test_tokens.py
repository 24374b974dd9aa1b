import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import ODD, docs_of, none, odd  # noqa: F401
from tallyspark.llm import bpe, idcoder, idfile
from tallyspark.llm.memo import Memo
from tallyspark.plans.shared import new_path

PATH = "/opt/tokenizers/"
PIECES = [" ", "  ", "\n", "\t", "\x0b", "a", "the ", "don't", "é", "́", "ß", "日本", "12", "...", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "x" * 70, "\U0001f600", "'S"]
ODD_TEXTS = ["", " ", "\n\n a", "<|endoftext|>x", "a <|endoftext|>\n b", "y" * 5000, "a\x1cb\x85c", "İstanbul ﬁ Σς", " lead", "trail ", "a  b", "a \n b"]


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    return ODD_TEXTS + ["".join(random.choices(PIECES, k=random.randint(0, 900))) for _ in range(120)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9) | st.integers(0, 65535), max_size=300), min_size=1, max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.uint16) for b in blocks]
    decoded = idcoder.decode(idcoder.encode(blocks), [len(b) for b in blocks])
    assert [b.tolist() for b in decoded] == [b.tolist() for b in blocks]


def test_coder_learns_and_blocks_are_independent():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 50_000, 40)
    block = np.tile(phrase, 50).astype(np.uint16)
    other = rng.integers(0, 50_000, 2048).astype(np.uint16)
    alone, together = idcoder.encode([block])[0], idcoder.encode([other, block, other[:7]])[1]
    assert alone == together
    assert len(alone) < len(block) // 4
    whole, tail = np.concatenate([block, other]), other
    assert idcoder.joined_checksum(idcoder.checksum(block), idcoder.checksum(tail), len(tail)) == idcoder.checksum(whole)


def test_chunked_encoding_equals_the_library(texts):
    own = bpe.ChunkEncoder(PATH + "word_bpe_49k.json")
    own.words = Memo(own.words.encode, size=50)  # generations turn over
    for part in (texts, texts[::-1]):
        want = own.tokenizer.encode_batch(part, add_special_tokens=False)
        got = own.encode(part)
        assert [g.tolist() for g in got] == [w.ids for w in want]
        assert [own.decode(g).decode() for g in got] == [own.tokenizer.decode(w.ids, skip_special_tokens=False) for w in want]


def test_piecewise_encoding_equals_the_library(texts):
    own = idfile.TextEncoder(PATH + "byte_bpe_50k.json")
    want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in own.encode(texts)] == [w.ids for w in want]


def test_chunks_follow_the_content():
    random.seed(2)
    shared = "".join(random.choices("abcdefgh ", k=20_000)).encode()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *bpe.cuts(d)[0][:-1].tolist()], bpe.cuts(d)[0].tolist())}
    first, second = pieces(b"start" + shared), pieces(b"another beginning" + shared + b"end")
    assert len(first & second) > 0.8 * len(first)
    assert b"".join([]) == b"" and bpe.cuts(b"")[0].tolist() == []


def test_id_files(spark, docs_of):
    rows = [(7, "seven words are in this very text"), (3, None), (5, "long " * 9000), (9, ""), (1, "a" * 300)]
    path = new_path(spark, "test-ids")
    idfile.write_ids(docs_of(rows), PATH + "byte_bpe_50k.json", path)
    tokenizer = idfile.text_encoder(PATH + "byte_bpe_50k.json").tokenizer
    at, want, ids_of = 0, [], {}
    for doc_id, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        ids_of[doc_id] = ids
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, idfile.document_digests(spark, path).collect())) == want
    assert {r.doc_id: r.ids for r in idfile.read_ids(spark, path).collect()} == ids_of


def test_id_files_of_odd_rows(spark, odd, none):
    path = new_path(spark, "test-ids")
    idfile.write_ids(odd, PATH + "byte_bpe_50k.json", path)
    assert idfile.document_digests(spark, path).count() == odd.count()
    empty = new_path(spark, "test-ids")
    idfile.write_ids(none, PATH + "byte_bpe_50k.json", empty)
    assert idfile.document_digests(spark, empty).collect() == []


def test_damage_is_found(spark, docs_of):
    path = new_path(spark, "test-ids")
    idfile.write_ids(docs_of(["some text that is long enough to be coded"]), PATH + "byte_bpe_50k.json", path)
    row = spark.read.parquet(path).first()
    with pytest.raises(ValueError, match="damaged"):
        import pyarrow as pa

        bad = dict(row.asDict(recursive=True), payload=bytes(len(row.payload)))
        list(idfile._decoded([pa.RecordBatch.from_pylist([bad])]))


def test_documents_round_trip(odd, none):
    rows = ODD

    tokenizer = bpe.ChunkEncoder(PATH + "word_bpe_49k.json").tokenizer
    want = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    got = bpe.encode_documents(odd, PATH + "word_bpe_49k.json").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digest_documents(none, PATH + "word_bpe_49k.json").collect() == []
