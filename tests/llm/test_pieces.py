import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import ODD, VOCABULARIES, docs_of, none, odd  # noqa: F401
from tallyspark.llm import pieces, queries
from tallyspark.llm.memo import Memo

PATH = f"{VOCABULARIES}/piece_bpe_32k.model"
PARTS = [
    " ", "  ", " " * 37, "\n", "\t", "\r", "a", "the ", "don't", "é", "́", "ß", "日本", "12", "...", "<s>", "</s>", "▁", "▁▁", "\x00",
    "\x85", "\xa0", "x" * 70, "\U0001f600", "());\r", "====", "tion", "ing", "﻿", "　", "ing the", "word,", "(it's)", "<0x0A>",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def agrees(library, texts):
    own = pieces.codec(PATH)
    found = own.encode(texts)
    want = library.encode(texts)
    assert [f.tolist() for f in found] == want
    assert [own.decode(f) for f in found] == library.decode(want)


def test_equals_the_library_on_odd_texts(library):
    random.seed(11)
    agrees(library, ["", " ", "  ", "a", "y" * 5000, " " * 5000, *["".join(random.choices(PARTS, k=random.randint(0, 60))) for _ in range(3000)]])


def test_equals_the_library_on_pieces_and_characters(library):
    random.seed(12)
    own = pieces.codec(PATH)
    names, letters = sorted(own.id), sorted(own.alphabet)
    agrees(library, ["".join(random.choices(names, k=9) + random.choices(letters, k=6)) for _ in range(3000)])
    agrees(library, ["".join(random.choices("abcdeinorst", k=40)) for _ in range(3000)])


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_equals_the_library_on_any_text(text):
    agrees(pieces.codec(PATH).library, [text])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12))
def test_decodes_any_ids(ids):
    own = pieces.codec(PATH)
    assert own.decode(np.array(ids, np.int64)) == own.library.decode(ids)


def test_backtracking_equals_merging():
    own = pieces.codec(PATH)
    random.seed(13)
    for _ in range(500):
        text = "".join(random.choices("▁aeinrst", k=random.randint(1, 25)))
        assert [own.names[i] for i in own.backtracked(text)] == own.merged(list(text))


def test_a_small_store_gives_the_same(library):
    own = pieces.PieceCodec(PATH)
    own.memo = Memo(own.memo.encode, size=40)
    random.seed(14)
    texts = ["".join(random.choices(PARTS, k=50)) for _ in range(40)]
    for part in (texts, texts[::-1]):
        assert [f.tolist() for f in own.encode(part)] == library.encode(part)


def test_documents(odd, none, library):
    want = []
    for doc_id, text, *_ in ODD:
        ids = library.encode(text or "")
        want.append((doc_id, ids, library.decode(ids)))
    assert sorted(map(tuple, pieces.encode_documents(odd, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.encode_documents(none, PATH).collect() == []
    assert pieces.digest_documents(none, PATH).collect() == []


def test_query_equals_the_library(spark, library, tmp_path, docs_of):
    random.seed(15)
    rows = [(i, t) for i, t in enumerate(["", None, *["".join(random.choices(PARTS, k=80)) for _ in range(200)]])]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for doc_id, text in rows:
        ids = library.encode(text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        want.add((doc_id, len(ids), *digests))
    assert {tuple(r) for r in queries.QUERIES["op11_piece_codec"](spark, str(tmp_path)).collect()} == want
