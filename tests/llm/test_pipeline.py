"""Each stage of the corpus pipeline against a brute-force version, on its own input."""

from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from tallyspark.llm import mixing
from tallyspark.llm.common import documents
from tallyspark.plans.shared import written
from test_simhash import components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """(input, output) of each stage, as written."""
    docs, out = documents(spark, SMALL), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SMALL), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def near(a, b, edits):
    """Whether b can be reached from a within some edits, by trying each edit at the first difference."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    return edits > 0 and any(near(x, y, edits - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def test_stages_are_in_order(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    for name in list(steps)[:-1]:
        assert steps[name][1].columns == COLUMNS


def test_language_stage(steps):
    docs, made = steps["language_id"]
    given = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in made.collect()}
    assert set(got) == {i for i, r in given.items() if any(c.isalpha() for c in r.text or "")}
    assert all(got[i].text == given[i].text and got[i].lang == given[i].lang for i in got)


def test_line_stage(steps):
    docs, made = steps["line_dedup"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    places = [(d, n, x.strip(" \t\n\x0b\x0c\r")) for d, t in rows for n, x in enumerate(t.split("\n"))]
    stays, gone, first, kept = defaultdict(list), set(), {}, defaultdict(list)
    for d, n, x in places:
        if x and x not in first:
            first[x] = (d, n)
            for y in (y for length in range(len(x) - 2, len(x) + 3) for y in stays[length]):
                edits = min(2, min(len(x), len(y)) // 20)
                if edits and near(x, y, edits):
                    gone.add(x)
                    break
            else:
                stays[len(x)].append(x)
        if not x or (first[x] == (d, n) and x not in gone):
            kept[d].append(dict(rows)[d].split("\n")[n])
    got = {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
    assert got == {d: ("\n".join(kept[d]), len("\n".join(kept[d]))) for d, _ in rows}


def test_near_duplicate_stage(steps):
    docs, made = steps["simhash_dedup"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = components([plain_fingerprint(t) for _, t in rows], 4)
    firsts = {}
    for (d, _), r in zip(rows, roots):
        firsts.setdefault(r, d)
    got = sorted((r.doc_id, r.text) for r in made.collect())
    assert got == [row for row in rows if row[0] in firsts.values()]


def test_mixing_stage(steps):
    docs, made = steps["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    want = Counter({(r.doc_id, r.text): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})
    assert Counter((r.doc_id, r.text) for r in made.collect()) == want


def test_encoding_stage(steps):
    docs, made = steps["bpe"]
    tokenizer = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
    rows = made.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == steps["bpe"][1].columns
    rows = lambda frame: sorted((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in frame.collect())
    assert rows(got) == rows(steps["bpe"][1])
