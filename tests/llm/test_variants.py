import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import ODD, docs_of, none, odd  # noqa: F401
from tallyspark.llm import queries, variants


def is_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def judged(counts):
    """word, form, root, n, n_near, form_n by comparing all words."""
    near = {w: [v for v in counts if is_one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def by_rule(rows, least_length=5, least_n=3):
    """The counted words of documents, straight from the definition."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}


def made_words(n, seed, letters="abeéÿ"):
    random.seed(seed)
    return sorted({"".join(random.choices(letters, k=random.randint(1, 9))) for _ in range(n)})


@pytest.fixture(scope="module")
def table(spark):
    words = [*made_words(900, 1), *("x" * k for k in (1, 2, 299, 300, 301)), "y" + "x" * 300]
    random.seed(2)
    return {w: random.choice([1, 1, 2, 3, 5, 8, 20, 100]) for w in words}


@pytest.mark.parametrize("cell,sample", [(16, 10_000), (8, 60), (10_000, 5)])
def test_equals_all_pairs(spark, table, cell, sample):
    words = spark.createDataFrame(list(table.items()), "word string, n long").repartition(7)
    got = variants.spelling_variants(words, cell=cell, sample=sample)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == judged(table)


def test_one_edit():
    words = [w for w in made_words(400, 3, "ab") if 3 <= len(w) <= 5]
    for n in (3, 4, 5):
        points = [w for w in words if len(w) == n]
        for m in (n, n + 1):
            q = [w for w in words if len(w) == m]
            if not q or not points:
                continue
            i, j = (x.ravel() for x in np.indices((len(q), len(points))))
            got = variants.one_edit(variants.letters_of(q)[i], variants.letters_of(points)[j])
            assert got.tolist() == [is_one_edit(q[a], points[b]) for a, b in zip(i, j)]


def test_a_search_loses_no_near_point():
    words = [w for w in made_words(3000, 4, "abcdeé") if len(w) in (6, 7)]
    six, seven = ([w for w in words if len(w) == n] for n in (6, 7))
    points = variants.counts_of(variants.letters_of(six))
    tree = variants.Tree(points, 4)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(len(six)))
    assert all(tree.home(points)[i] == leaf for leaf, own in enumerate(tree.leaves) for i in own)
    for queries_, more in ((six, 1), (seven, 0)):
        counts = variants.counts_of(variants.letters_of(queries_))
        met = {(int(q), int(p)) for leaf, own in tree.search(counts, 1, more) for q in own for p in tree.leaves[leaf]}
        want = {(q, p) for q, a in enumerate(queries_) for p, b in enumerate(six) if is_one_edit(a, b)}
        assert want <= met and len(met) < len(queries_) * len(six) / 2


def test_last_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w3"), ("b", "w3")]
    got = variants.last_forms(spark.createDataFrame(chain, "word string, form string"))
    assert {tuple(r) for r in got.collect()} == {(w, "w37") for w, _ in chain}


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    random.seed(5)
    frequent = made_words(300, 6, "abÀé")
    rows = [(i, " ".join(random.choices(frequent, k=120)) + random.choice([". Aébcd", "-1x", "\n", "́e", "Ä×÷"])) for i in range(150)]
    rows += [(None, "Aébcd aébcd ÀBCDE àbcde"), (200, None), (201, ""), (7, rows[7][1]), (202, "z" * 3000 + " " + "z" * 2999)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = judged(by_rule(rows))
    assert any(w != root for w, _, root, *_ in want) and any(k > 2 for *_, k, _ in want)
    assert {tuple(r) for r in queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()} == want


def test_damage_and_counts(docs_of, odd, none):
    rows = [(i, "wordly Wordly wordlyness ÉÉÉÉÉ") for i in range(400)] + [(r[0], r[1]) for r in ODD]
    want = by_rule(rows, 0, 1)
    assert {len(w) for w in want} > {5, 6} and any(w == "ordly" for w in want)
    assert {r.word: r.n for r in variants.document_words(docs_of(rows), 0, 1).collect()} == want
    assert variants.document_words(none, 0, 1).collect() == []


def test_empty_and_odd_tables(spark, odd, none):
    assert variants.spelling_variants(variants.document_words(none)).collect() == []
    assert {tuple(r) for r in variants.spelling_variants(variants.document_words(odd)).collect()} == set()
    lone = spark.createDataFrame([("", 9), ("a", 2), ("b", 4)], "word string, n long")
    assert {tuple(r) for r in variants.spelling_variants(lone).collect()} == {
        ("", None, "", 9, 0, None), ("a", "b", "b", 2, 1, 4), ("b", None, "b", 4, 1, None),
    }
