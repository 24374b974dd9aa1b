import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import ODD, docs_of, none, odd  # noqa: F401
from tallyspark.llm import exact
from tallyspark.llm.exact import CountingQuotientFilter, Slicing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**54 - 1) | st.integers(0, 40), min_size=1), min_size=1, max_size=5))
def test_filters_merge_losslessly(parts):
    made = []
    for part in parts:
        values, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        made.append(CountingQuotientFilter.from_row(CountingQuotientFilter.of(values, counts.astype(np.int64), 54).to_row(), 54))
    merged = CountingQuotientFilter.merge(made)
    values, counts = np.unique(np.array(sum(parts, []), np.uint64), return_counts=True)
    assert merged.values().tolist() == values.tolist()
    assert merged.counts.tolist() == counts.tolist()


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, keep if len(own) > 1 else d, len(own), d == keep, digest) for d, _ in own]
    return sorted(out, key=repr)


def test_matches_brute_force(docs_of):
    random.seed(1)
    rows = [(i, random.choice(["a b", "ab", "a\nb ", "abc", "é e", "", None, " "]) ) for i in range(200)]
    assert sorted(map(tuple, exact.exact_dedup(docs_of(rows)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("cut", [Slicing(2, 5), Slicing(5, 8), Slicing(14, 17), Slicing(14, 28)])
def test_result_does_not_depend_on_slices_or_full_marks(docs_of, cut):
    random.seed(2)
    rows = [(i, f"{random.choice('xyz')} {random.randrange(120)}") for i in range(300)]
    assert sorted(map(tuple, exact.exact_dedup(docs_of(rows), cut=cut).collect()), key=repr) == brute(rows)


def test_slices_and_marks_follow_the_rows():
    of = {rows: Slicing.of(rows) for rows in (0, 1, 256_410, 10**8, 5 * 10**10, 10**13)}
    assert of[0] == of[1] == of[256_410] == Slicing(10, 23)
    for rows, cut in of.items():
        assert rows >> cut.slice_bits <= 1 << 22  # fingerprints that are merged together
        assert 3 <= cut.quotient_bits and cut.mark_bits <= 28
    assert of[5 * 10**10].slice_bits == 14 and of[10**8].mark_bits == 28


def test_odd_rows(odd, none):
    got = [tuple(r) for r in exact.exact_dedup(odd).collect()]
    rows = ODD

    assert sorted(got, key=repr) == brute([r[:2] for r in rows])
    assert exact.exact_dedup(none).collect() == []
