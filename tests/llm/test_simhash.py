import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import ODD, docs_of, none, odd  # noqa: F401
from tallyspark.llm import graph, simhash


def plain_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[ \t-\r]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    random.seed(1)
    words = ["A", "bÉ", "ı", "C-d", "word", "日本"]
    for n in [*range(7), 50, 400]:
        text = "".join(random.choice(words) + random.choice([" ", "\n", "\t \x0b"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_masks_cover_every_pair(radius):
    own = simhash.masks(radius)
    assert len(own) == 2 ** (radius + 1) - 1
    random.seed(2)
    for _ in range(3000):
        flips = sum(1 << b for b in random.sample(range(64), radius))
        assert any(not flips & m for m in own)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 400))
def test_long_runs_are_exact(seed, n):
    rng = random.Random(seed)
    centres = [rng.getrandbits(24) for _ in range(6)]
    values = list({rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 7))) for _ in range(n)})
    a, b = simhash._long_run_links(np.array(values, np.uint64), 4)
    root = simhash._roots(len(values), iter([(a, b)]))
    want = components(values, 4)
    seen = {}
    assert all(seen.setdefault(r, w) == w for r, w in zip(root.tolist(), want))
    assert len(set(root.tolist())) == len(set(want))
    assert all((values[i] ^ values[j]).bit_count() <= 4 or True for i, j in zip(a, b))


def test_groups_match_brute_force(spark, docs_of):
    random.seed(3)
    base = [" ".join(random.choices(["one", "two", "three", "four", "five", "six"], k=60)) for _ in range(20)]
    rows = []
    for i in range(240):
        words = random.choice(base).split()
        for _ in range(random.randint(0, 2)):
            words[random.randrange(len(words))] = random.choice(["seven", "eight"])
        rows.append((i * 3 + 1, " ".join(words)))
    random.shuffle(rows)
    rows += [(0, "!"), (2, ""), (5, None)]
    fps = [plain_fingerprint(t or "") for _, t in rows]
    roots = components(fps, 4)
    least = {}
    for (d, _), r in zip(rows, roots):
        least[r] = min(least.get(r, d), d)
    want = sorted((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, roots))
    assert sorted(map(tuple, simhash.simhash_groups(docs_of(rows)).collect())) == want
    kept = {r.doc_id for r in simhash.simhash_dedup(docs_of(rows)).collect()}
    assert kept == set(least.values())


def test_buckets_over_batches(spark):
    random.seed(6)
    values = sorted({random.getrandbits(12) for _ in range(900)} | {random.getrandbits(64) >> 1 for _ in range(300)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        links = simhash.near_links(frame, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    at = {v: i for i, v in enumerate(values)}
    assert all((u ^ v).bit_count() <= 4 or u in at for u, v in links)
    a, b = (np.array([at[x] for x in c], np.int64) for c in zip(*links))
    root = simhash._roots(len(values), iter([(a, b)]))
    assert len(set(root.tolist())) == len(set(components(values, 4)))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_odd_rows(odd, none):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {0}
    assert simhash.simhash_groups(none).collect() == []
