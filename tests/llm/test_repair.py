import hashlib
import heapq
import random
import re
import zlib

import pytest

from llm_fixtures import docs_of  # noqa: F401
from tallyspark.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def audits(rows):
    """The cheapest edits of (role, text, must go, truncated) rows by search over whole edit strings:
    least cost first, then least audit."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if (at, roles[-1:] if roles else "-") in done:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        # Same place and same last role admit the same continuations, and the first to come is the best.
        done.add((at, roles[-1:] if roles else "-"))

        def go(price, letter, to, line, at=at):
            role = line.split(":")[0][:1] if line is not None else ""
            grown = roles + role
            if line is not None and not re.fullmatch("s?(ua)*u?", grown) or (line is not None and not role):
                return
            heapq.heappush(heap, (cost + price, audit + letter, to, grown, lines + ((line,) if line is not None else ())))

        for role in ("user", "assistant"):
            go(5, "I", at, role + ":")
        if at < len(rows):
            role, text, gone, cut = rows[at]
            go(2, "D", at + 1, None)
            if not gone:
                go(5 * cut, "K", at + 1, f"{role}:{text}")
                for other in ("user", "assistant"):
                    go(1 + 5 * cut, "R", at + 1, f"{other}:{text}")


def expected(given):
    """What the query returns, from the rows of (conv_id, turn, role, text), straight from the rules."""
    out = set()
    for conv in {r[0] for r in given}:
        rows = []
        for conv_id, turn, role, text in given:
            if conv_id != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            if h == 1:
                text = ""
            if h == 2:
                text = re.sub("[.!?]", "", text)
            if h == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = dict(blank=0, duplicate=0, truncated=0)
        said, judged = set(), []
        for _, role, text in rows:
            fault = None
            if not text.strip(SPACE):
                fault = "blank"
            elif (role, text) in said:
                fault = "duplicate"
            elif text.rstrip(SPACE)[-1] not in ".!?":
                fault = "truncated"
            said.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = audits(judged)
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(conversations, seed, longest=9):
    random.seed(seed)
    rows = []
    for conv in range(conversations):
        good = random.random() < 0.4
        for turn in range(random.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if good else random.choice(["system", "user", "assistant", "tool", "", None, "User"])
            text = random.choice(["Yes.", "No!", "cut", " \n", "", None, "a. b", "é?\t", f"t{turn}.", f"t{turn}"])
            at = turn if random.random() < 0.9 else random.choice([None, turn + 2, 0])
            rows.append((conv, at, role, text))
    return rows


ODD = [
    (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (-5, None, None, None), (-6, 3, "system", "Only."),
    (-7, 0, "user", "word " * 40_000 + "."), (-7, 1, "assistant", "x" * 300_000), *[(-8, 0, "user", "Same.")] * 40, (-9, 10**12, "user", "a."), (-9, 0, "user", "b."),
]


def rows_of(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return [tuple(r) for r in frame.select(names).collect()]


@pytest.mark.parametrize("chunk_rows,chunk_bytes,longest", [(2048, 1 << 18, 9), (1, 1, 9), (3, 1 << 18, 40)])
def test_equals_search(spark, chunk_rows, chunk_bytes, longest):
    given = made(150, longest, longest) + ODD
    random.shuffle(given)
    frame = spark.createDataFrame(given, TURNS).selectExpr("*", "'x' AS n", "'x' AS conv", "1 AS place", "2 AS copies")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # so that chunks are small
    try:
        got = rows_of(repair.repair_conversations(repair.damaged(frame), chunk_rows, chunk_bytes))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert len(got) == len(set(got)) and set(got) == expected(given)


def test_hot_conversation_in_many_chunks(spark):
    random.seed(8)
    roles = ["user", "assistant", "user", "tool", "assistant", "system"]
    given = [(1, t, random.choice(roles), random.choice(["Again.", f"Text {t}.", f"cut {t}", ""])) for t in range(3000)]
    given += [(1, 5, "user", "Same.")] * 500 + [(2, t, "tool", f"{t}.") for t in range(1500)] + [(3, t, "user", "Same.") for t in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = rows_of(repair.repair_conversations(repair.damaged(spark.createDataFrame(given, TURNS)), 50, 1 << 18))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert set(got) == expected(given)


def test_passes_do_not_follow_the_number_of_chunks(spark):
    random.seed(9)
    kinds = {"even": bytes([1, 2]) * 20, "other": bytes([3]) * 41, "mixed": bytes(random.choices(range(8), k=40)), "none": b""}
    rows = [(conv, place + 1, codes if conv != "mixed" else bytes(random.choices(range(8), k=40))) for conv, codes in kinds.items() for place in range(60)]
    chunks = spark.createDataFrame(rows, "conv string, place long, codes binary")
    passes = repair.converged(chunks)
    assert len(passes) <= 6
    # The vectors that fit each other are those of one pass over all rows.
    found = {(r.conv, r.place, tuple(r.came)): tuple(r.went) for p in passes for r in p.collect()}
    for conv in kinds:
        came = repair.END
        for _, place, codes in sorted((r for r in rows if r[0] == conv), key=lambda r: -r[1]):
            want = repair.backward(bytes(codes), came)[0][0]
            came = found[conv, place, came]
            assert came == want


def test_query_equals_search(spark, tmp_path):
    given = made(200, 4) + ODD
    spark.createDataFrame(given, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path)))
    assert len(got) == len({r[0] for r in given}) and set(got) == expected(given)


def test_no_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert rows_of(repair.repair_conversations(repair.damaged(none))) == []
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    lost = spark.createDataFrame([(1, gone, "user", "a.")], TURNS)
    assert rows_of(repair.repair_conversations(repair.damaged(lost))) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
