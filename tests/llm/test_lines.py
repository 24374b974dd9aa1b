import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import ODD, docs_of, none, odd  # noqa: F401
from tallyspark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prior, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prior, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prior + (x != y))
    return row[-1]


def mutate(text, n):
    chars = list(text)
    for _ in range(n):
        at, what = random.randrange(len(chars) + 1), random.random()
        if what < 0.34:
            chars.insert(at, random.choice("abé"))
        elif chars and what < 0.67:
            chars.pop(min(at, len(chars) - 1))
        elif chars:
            chars[min(at, len(chars) - 1)] = random.choice("abé")
    return "".join(chars)


def brute(rows, edits=2, unit=20, min_chars=1):
    """The dropped line numbers of each document: lines in order, each against all that stay."""
    places = sorted(
        ((d is None, d, n, x.strip(" \t\n\x0b\x0c\r")) for d, t, *_ in rows for n, x in enumerate((t or "").split("\n"))),
        key=lambda p: (p[0], p[1] or 0, p[2]),
    )
    kept, gone, first, dropped = [], set(), {}, defaultdict(set)
    for _, d, n, x in places:
        if len(x) < max(1, min_chars):
            continue
        if x not in first:
            first[x] = (d, n)
            for k in kept:
                short = min(len(k), len(x))
                most = max((e for e in range(1, edits + 1) if short >= max(e * unit, 2 * e + 1)), default=0)
                if most and abs(len(k) - len(x)) <= most and distance(k, x) <= most:
                    gone.add(x)
                    break
            else:
                kept.append(x)
        if x in gone or first[x] != (d, n):
            dropped[d].add(n)
    return {d: sorted(n) for d, n in dropped.items()}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance_check(spark, edits):
    random.seed(edits)
    rows = []
    for _ in range(1500):
        a = "".join(random.choices("abé", k=random.randint(0, 40)))
        rows.append((a, mutate(a, random.randint(0, 5))))
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(lines.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    assert [r.w for r in got] == [distance(a, b) <= edits for a, b in rows]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_lines_match_brute_force(docs_of, edits):
    random.seed(10 + edits)
    base = ["".join(random.choices("ab é", k=random.randint(3, 30))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = [random.choice(["", " ", "\t"]) + mutate(random.choice(base), random.choice([0, 0, 1, 2])) for _ in range(random.randint(1, 6))]
        rows.append((i, "\n".join(own)))
    settings = {"edits": edits, "unit": 8, "min_chars": 4}
    want = brute(rows, **settings)
    got = {r.doc_id: r.dropped for r in lines.dropped_lines(docs_of(rows), **settings).collect()}
    assert got == want
    texts = {r.doc_id: (r.text, r.n_chars) for r in lines.line_dedup(docs_of(rows), **settings).collect()}
    for d, t in rows:
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want.get(d, []))
        assert texts[d] == (kept, len(kept))


@pytest.mark.parametrize("digits", [3, 6])
def test_large_groups_are_compared_in_blocks(docs_of, digits):
    random.seed(20)
    template = "a template line that many documents share, with number "
    rows = [(i, template + f"{random.randrange(10**digits):06d}") for i in range(400)]
    got = {r.doc_id: r.dropped for r in lines.dropped_lines(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_classes_of_many_rounds(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    random.seed(21)
    rows = [(i, "some line of twenty and more " + "".join(random.choices("ab", k=7))) for i in range(45)]
    want = brute(rows)
    assert {r.doc_id: r.dropped for r in lines.dropped_lines(docs_of(rows)).collect()} == want
    assert 2 * 5 < len(rows) - len(want)


def test_different_numbers_stay(docs_of):
    rows = [(i, str(10_000 + 7 * i)) for i in range(3000)]
    assert lines.dropped_lines(docs_of(rows)).collect() == []


def test_every_dropped_line_is_near_the_one_that_stays(docs_of):
    random.seed(22)
    chain = ["the first line of a long chain of changes, which go on and on"]
    for _ in range(60):
        chain.append(mutate(chain[-1], 1))
    random.shuffle(chain)
    rows = list(enumerate(chain))
    found = lines.repeated_lines(docs_of(rows)).collect()
    text = {hashlib.sha256(t.encode()).digest()[:16]: t for t in chain}
    assert found and all(distance(chain[r.doc_id], text[bytes(r.stays)]) <= 2 for r in found)
    assert {r.doc_id for r in found} == set(brute(rows))


def test_odd_rows(odd, none):
    report = lines.line_report(odd).collect()
    assert len(report) == len(ODD)
    assert {r.doc_id: r.dropped for r in report if r.dropped} == brute(ODD)
    assert sorted(r.text or "" for r in lines.line_dedup(odd).collect())[-1] == "é́ 日本語 \U0001f600 <|endoftext|>"
    assert lines.line_report(none).collect() == [] and lines.line_dedup(none).columns == none.columns


def test_the_distance_follows_the_length(docs_of):
    short, middle, long_ = "Read more of it", "See also: the notes below", "A line of more than forty code points, as is usual here"
    texts = [short, short[:-1], middle, middle[:-1], middle[:-2], long_, long_[:-2], long_[:-3] + "x", "1234", "1235", "ok", "ok", "", "", short]
    rows = list(enumerate(texts))
    want = {3: [0], 6: [0], 11: [0], 14: [0]}
    assert brute(rows) == want and {r.doc_id: r.dropped for r in lines.dropped_lines(docs_of(rows)).collect()} == want


def test_a_shuffled_key_is_two_numbers_with_zero_upper_bytes(spark):
    texts = [(bytes([i]) * 16, "a line of some forty code points, with number %02d" % i) for i in range(30)]
    frame = spark.createDataFrame(texts, "id binary, line string").select("*", lines.line_hash(F.col("id")).alias("line64"), F.length("line").alias("n"))
    coded = lines.coded_keys(frame, 2, 20)
    assert coded.columns == ["key", "code"]
    rows = coded.collect()
    assert all(0 <= r.code < 1 << 48 for r in rows)
    got = sorted((r.key, r.code >> 1, r.code & 1 == 1) for r in rows)
    assert got == sorted(map(tuple, lines.keys(frame, 2, 20).collect()))
    assert {h for _, h, _ in got} == {r.line64 for r in frame.collect()} and len({h for _, h, _ in got}) == 30


def test_lines_that_share_a_short_hash_are_told_apart(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "LINE_BITS", 3)
    random.seed(23)
    base = ["".join(random.choices("abcdé ", k=random.randint(18, 60))) for _ in range(20)]
    rows = [(i, "\n".join(mutate(random.choice(base), random.choice([0, 1, 2, 3])) for _ in range(4))) for i in range(25)]
    assert {r.doc_id: r.dropped for r in lines.dropped_lines(docs_of(rows)).collect()} == brute(rows)


def test_keys_are_made_in_methods_that_the_jvm_compiles(spark, tmp_path):
    """A lambda in the generator leaves it to Spark's interpreter, and a method of 8,000 bytes of code
    or more to the JVM's."""
    spark.createDataFrame([("x" * 60, 1, 60)], "line string, line64 long, n int").write.parquet(f"{tmp_path}/lines")
    found = lines.coded_keys(spark.read.parquet(f"{tmp_path}/lines"), 2, 20)
    told = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
    generators = re.findall(r"(\*\(\d+\) )?Generate inline", found._jdf.queryExecution().executedPlan().toString())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert generators and all(generators)
    assert len(sizes) == len(generators) and max(sizes) < 8000


def test_every_key_of_a_line_by_brute_force(spark):
    """A line of n code points has its own segments, and meets every line that is at most its edits
    shorter under at least one key where that line is indexed."""
    random.seed(5)
    texts = sorted({"".join(random.choices("abc é", k=n)) for n in (19, 20, 21, 39, 40, 41, 42, 60) for _ in range(3)})
    texts += sorted({mutate(t, 1) for t in texts} | {mutate(t, 2) for t in texts} - set(texts))
    frame = spark.createDataFrame([(t, i, len(t)) for i, t in enumerate(texts)], "line string, line64 long, n int")
    own, all_ = defaultdict(set), defaultdict(set)
    for key, i, indexed in lines.keys(frame, 2, 20).collect():
        all_[i].add(key)
        if indexed:
            own[i].add(key)
    near = 0
    for i, a in enumerate(texts):
        assert len(own[i]) == (0 if len(a) < 20 else 2 if len(a) < 40 else 3)
        for j, b in enumerate(texts):
            if len(a) <= len(b) and a != b and distance(a, b) <= min(2, len(a) // 20):
                near += 1
                assert own[i] & all_[j]
    assert near > 20
