"""Conversation repair: the cheapest edits that make the roles read system? (user assistant)*.

Least costs are a Viterbi pass over four states, backwards through a conversation: nothing said yet,
system said, user said, assistant said. A state's cost at a row depends on the costs behind it only
up to a constant, so cost vectors are kept with their least entry at zero. A long conversation is cut
into chunks that are passed in parallel by rank convergence: every chunk starts from a speculative
vector at its end, the one of a conversation's end; then fix-up passes rerun a chunk as long as the
vector that its successor has come to differs, by more than a constant, from all the chunk has been
run with. Rows make most differences vanish after a few steps, and where they don't, few vectors are
possible, so passes don't follow the number of chunks. Vectors and constants are then stitched from
the last chunk to the first, and the edits are traced forward along the stitched costs: where several
are cheapest, the one with the least letter. A letter determines the state it leads to, so this gives
the least audit.

Rows that must go (blank, or said before) change no state: they are kept as counts between the others,
so that a long stretch of them cannot hold up convergence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import workers_ready
from tallyspark.plans.shared import written

#: A chunk is closed by the first batch that takes it to so many rows or bytes.
CHUNK_ROWS, CHUNK_BYTES = 2048, 1 << 18
_SPACE = " \t\n\v\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The only turn that may be put in, or a role be changed to, and where it leads.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KINDS = "sua"
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Costs behind the last row: what must still be put in.
END = (0, 2 * INSERT, INSERT, 0)


@cache
def step(behind: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """A row that need not go: (costs before it, less their least; the least; for each state the
    letters of the least audit up to and including the row, and the state behind it).

    `code` is the role's kind (system, user, assistant, other) and 4 if the text is truncated."""
    kind, more = code & 3, TRUNCATED * (code >> 2)
    keep = [behind[_KEPT[q, kind]] + more if (q, kind) in _KEPT else None for q in range(4)]
    change = [behind[_NEXT[q]] + more + REROLE for q in range(4)]
    cost = [min(x for x in (behind[q] + DELETE, keep[q], change[q]) if x is not None) for q in range(4)]
    for _ in range(3):
        cost = [min(cost[q], INSERT + cost[_NEXT[q]]) for q in range(4)]

    def traced(q):
        letters = ""
        while True:
            if cost[q] == behind[q] + DELETE:
                return letters + "D", q
            if cost[q] == INSERT + cost[_NEXT[q]]:
                letters, q = letters + "I", _NEXT[q]
            elif cost[q] == keep[q]:
                return letters + "K", _KEPT[q, kind]
            else:
                return letters + "R", _NEXT[q]

    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(map(traced, range(4)))


def backward(codes: bytes, behind: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
    """The cost vectors behind every row and before the first, and the sum of their constants."""
    vectors, total = [behind], 0
    for code in reversed(codes):
        behind, least, _ = step(behind, code)
        vectors.append(behind)
        total += least
    return vectors[::-1], total


def ends(codes: bytes, vectors: list[tuple[int, ...]]) -> list[int]:
    """Where the cheapest edits lead from each state."""
    at = [*range(4)]
    for i, code in enumerate(codes):
        moves = step(vectors[i + 1], code)[2]
        at = [moves[q][1] for q in at]
        if at[0] == at[1] == at[2] == at[3]:
            q = at[0]
            for j in range(i + 1, len(codes)):
                q = step(vectors[j + 1], codes[j])[2][q][1]
            return [q] * 4
    return at


class Facts:
    """What a chunk's rows are: `codes` of those that need not go, `gone` rows before each of them and
    behind the last (counts), `rows` (their numbers) and the fault counts."""

    def __init__(self, roles: list[str], texts: list[str], copies: list[int], fresh: set[int] | None = None):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        codes, self.gone, self.rows = bytearray(), [0], []
        said: set[tuple[str, str]] = set()
        before = None
        self.first = self.last = None  # roles' initials
        for i, (role, text, n) in enumerate(zip(roles, texts, copies)):
            if not n:  # stands for a conversation without rows
                continue
            initial = role[:1]
            if self.first is None:
                self.first = initial
            elif before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            if n > 1 and initial + initial not in ("su", "ua", "au"):
                self.illegal += n - 1
            before = self.last = initial
            end = text.rstrip(_SPACE)[-1:]
            if not end:
                self.blank += n
                self.gone[-1] += n
                continue
            if (role, text) in said or (fresh is not None and i not in fresh):
                self.duplicate += n
                self.gone[-1] += n
                continue
            said.add((role, text))
            self.duplicate += n - 1
            cut = end not in ".!?"
            self.truncated += cut
            kind = _KINDS.find(initial) if initial else 3
            codes.append((kind if kind >= 0 else 3) + 4 * cut)
            self.rows.append(i)
            self.gone.append(n - 1)
        self.codes = bytes(codes)


def trace(facts: Facts, vectors: list[tuple[int, ...]], state: int, roles: list[str], texts: list[str], last: bool) -> tuple[str, list[str], int]:
    """(audit, repaired lines, state behind) of a chunk entered in `state`."""
    audit, lines = [], []

    def put_in(q):
        lines.append(_ROLE[_NEXT[q]] + ":")
        return _NEXT[q]

    for i, code in enumerate(facts.codes):
        audit.append("D" * facts.gone[i])
        letters, behind = step(vectors[i + 1], code)[2][state]
        audit.append(letters)
        for _ in letters[:-1]:
            state = put_in(state)
        row = facts.rows[i]
        if letters[-1] == "K":
            lines.append(f"{roles[row]}:{texts[row]}")
        elif letters[-1] == "R":
            lines.append(f"{_ROLE[_NEXT[state]]}:{texts[row]}")
        state = behind
    audit.append("D" * facts.gone[-1])
    while last and END[state]:
        audit.append("I")
        state = put_in(state)
    return "".join(audit), lines, state


def _turn_facts(turns: list, copies: list[int]) -> tuple[int | None, int | None, int]:
    """Least, greatest and number of different turns that are not null; they come sorted."""
    own = [t for t, n in zip(turns, copies) if n and t is not None]
    return (own[0], own[-1], 1 + sum(a != b for a, b in zip(own, own[1:]))) if own else (None, None, 0)


def _gaps(least, most, different) -> int:
    return most - least + 1 - different if different else 0


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) -> dict:
    return dict(
        gaps=gaps, blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, cost=cost, audit=audit, repaired_sha256=digest
    )


def _one_chunk(chunk: dict) -> dict:
    roles, texts, copies = chunk["roles"], chunk["texts"], chunk["copies"]
    facts = Facts(roles, texts, copies)
    vectors, least = backward(facts.codes, END)
    audit, lines, _ = trace(facts, vectors, START, roles, texts, True)
    cost = least + vectors[0][START] + DELETE * sum(facts.gone)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return _result(_gaps(*_turn_facts(chunk["turns"], copies)), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, digest)


def _by_rows(make, schema: pa.Schema, at_once: int = 256):
    """An Arrow function from one that makes rows from rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in make(row for b in batches for part in range(0, len(b), at_once) for row in b.slice(part, at_once).to_pylist()):
            held.append(row)
            if len(held) >= at_once:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _schema(ddl: str, first: pa.Field | None = None) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [pa.field(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))]
    return pa.schema([*([first] if first else []), *fields])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, n) as rows of lists, a conversation each, or a chunk of
    a long one. `alone` is true where no other task can hold rows of the conversation."""
    part, no, first, pending, goes_on = TaskContext.get().partitionId(), 0, True, None, False

    def listed(table: pa.Table, starts: list[int], alone: list[bool]) -> pa.RecordBatch:
        nonlocal no
        flat = table.combine_chunks()
        offsets = pa.array([*starts, len(table)], pa.int32())
        lists = {
            name: pa.ListArray.from_arrays(offsets, flat.column(i).chunk(0))
            for i, name in ((1, "turns"), (2, "roles"), (3, "texts"), (4, "copies"))
        }
        own = flat.column(0).chunk(0).take(pa.array(starts))
        numbers = pa.array(range(no, no + len(starts)), pa.int64())
        no += len(starts)
        return pa.record_batch({"conv_id": own, "part": pa.array([part] * len(starts), pa.int64()), "no": numbers, **lists, "alone": pa.array(alone)})

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if pending is None else pa.concat_tables([pending, table])
        ids = table.column(0).combine_chunks()
        same = pa.compute.fill_null(pa.compute.equal(ids[1:], ids[:-1]), False)
        both_null = pa.compute.and_(pa.compute.is_null(ids[1:]), pa.compute.is_null(ids[:-1]))
        starts = [0, *(np.flatnonzero(~pa.compute.or_(same, both_null).to_numpy(False)) + 1).tolist()]
        last = starts[-1]
        if last:
            # Its first conversation may have begun in another task or in an earlier chunk.
            yield listed(table.slice(0, last), starts[:-1], [not (first or goes_on), *[True] * (len(starts) - 2)])
            first = goes_on = False
        pending = table.slice(last)
        if len(pending) >= rows or pending.nbytes >= size:
            yield listed(pending, [0], [False])
            pending, goes_on = None, True
            # The next batch may begin with another conversation; then it is taken for a chunk more, which is harmless.
    if pending is not None:
        yield listed(pending, [0], [False])


_CHUNK = "part long, no long, turns array<{turn}>, roles array<string>, texts array<string>, copies array<long>, alone boolean"


def _chunked(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """The written chunks. Equal rows become one with their number first, so that no sort key is hot."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    there = F.col("copies") > 0
    cleaned = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(there, F.coalesce("text", F.lit(" "))).alias("text"), "copies",
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    counted = cleaned.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("n"))
    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"conv_id {kinds['conv_id']}, {_CHUNK.format(turn=kinds['turn'])}"
    return written(dealt.mapInArrow(lambda b: _chunks(b, chunk_rows, chunk_bytes), schema), "repair-chunks")


_SUMMARY = "conv string, place long, blank long, duplicate long, truncated long, illegal long, first string, last string, gone long, codes binary"


def _first_rows(rows: Iterator[dict]) -> Iterator[dict]:
    """Of each chunk the first row of every text that is not blank: (conv, place, row, role, digest)."""
    for chunk in rows:
        said = set()
        for i, (role, text, n) in enumerate(zip(chunk["roles"], chunk["texts"], chunk["copies"])):
            if n and text.strip(_SPACE) and (role, text) not in said:
                said.add((role, text))
                yield dict(conv=chunk["conv"], place=chunk["place"], row=i, role=role, digest=hashlib.sha256(text.encode()).digest())


def _facts(chunk: dict) -> Facts:
    return Facts(chunk["roles"], chunk["texts"], chunk["copies"], set(chunk["fresh"] or ()))


def _summaries(rows: Iterator[dict]) -> Iterator[dict]:
    for chunk in rows:
        f = _facts(chunk)
        yield dict(
            conv=chunk["conv"], place=chunk["place"], blank=f.blank, duplicate=f.duplicate, truncated=f.truncated, illegal=f.illegal,
            first=f.first, last=f.last, gone=sum(f.gone), codes=f.codes,
        )


_RUN = "conv string, place long, came array<int>, went array<int>, least long, ends array<int>"


def _runs(rows: Iterator[dict]) -> Iterator[dict]:
    """Chunks run with the vectors they `came` to at their end."""
    for chunk in rows:
        vectors, least = backward(chunk["codes"], tuple(chunk["came"]))
        yield dict(
            conv=chunk["conv"], place=chunk["place"], came=chunk["came"], went=vectors[0], least=least, ends=ends(chunk["codes"], vectors)
        )


def converged(chunks: DataFrame) -> list[DataFrame]:
    """Runs of all chunks (conv, place, codes) such that for every run of a chunk, the chunk before
    it has been run with the vector that this one went to. Each pass is a written table."""
    passes = []
    wanted = chunks.select("conv", "place", "codes", F.array(*map(F.lit, END)).alias("came"))
    while True:
        new = written(wanted.mapInArrow(_by_rows(_runs, _schema(_RUN)), _RUN), "repair-runs")
        passes.append(new)
        known = new
        for earlier in passes[:-1]:
            known = known.union(earlier)
        left = new.filter("place > 1").select("conv", (F.col("place") - 1).alias("place"), F.col("went").alias("came")).distinct()
        left = written(left.join(known, ["conv", "place", "came"], "left_anti"), "repair-wanted")
        if not left.limit(1).count():
            return passes
        wanted = left.join(chunks.select("conv", "place", "codes"), ["conv", "place"]).select("conv", "place", "codes", "came")


_CHOSEN = "conv string, place long, came array<int>, ends array<int>, cost long"


def _stitched(rows: Iterator[dict]) -> Iterator[dict]:
    """The runs that fit each other, from a conversation's last chunk to its first. `cost` is what
    the rows from this chunk on cost from a conversation's start."""
    conv, at, came, before = object(), None, END, 0
    for run in rows:
        if run["conv"] != conv:
            conv, at, came, before = run["conv"], run["place"], END, 0
        if run["place"] != at or tuple(run["came"]) != tuple(came):
            continue
        at -= 1
        came = run["went"]
        before += run["least"]
        yield dict(conv=conv, place=run["place"], came=run["came"], ends=run["ends"], cost=before + came[START])


_ENTERED = "conv string, place long, came array<int>, state int, cost long"


def _entered(rows: Iterator[dict]) -> Iterator[dict]:
    conv, state = object(), START
    for run in rows:
        if run["conv"] != conv:
            conv, state = run["conv"], START
        yield dict(conv=conv, place=run["place"], came=run["came"], state=state, cost=run["cost"])
        state = run["ends"][state]


_TRACED = (
    "conv string, place long, blank long, duplicate long, truncated long, illegal long, first string, last string, gone long, cost long, "
    "least long, most long, different long, audit string, has_lines int, repaired string"
)


def _traced(rows: Iterator[dict]) -> Iterator[dict]:
    for chunk in rows:
        f = _facts(chunk)
        vectors, _ = backward(f.codes, tuple(chunk["came"]))
        audit, lines, _ = trace(f, vectors, chunk["state"], chunk["roles"], chunk["texts"], chunk["place"] == chunk["of"])
        least, most, different = _turn_facts(chunk["turns"], chunk["copies"])
        yield dict(
            conv=chunk["conv"], place=chunk["place"], blank=f.blank, duplicate=f.duplicate, truncated=f.truncated, illegal=f.illegal,
            first=f.first, last=f.last, gone=sum(f.gone), cost=chunk["cost"], least=least, most=most, different=different,
            audit=audit, has_lines=int(bool(lines)), repaired="\n".join(lines),
        )


def _joined(rows: Iterator[dict]) -> Iterator[dict]:
    """Traced chunks, sorted by conversation and place, to one row a conversation; its cost is that
    from the first chunk on. The digest reads a
    conversation's text in order and keeps nothing of it."""
    now = None

    def closed():
        return dict(
            conv=now["conv"],
            **_result(
                _gaps(now["least"], now["most"], now["different"]), now["blank"], now["duplicate"], now["truncated"], now["illegal"],
                now["cost"] + DELETE * now["gone"], "".join(now["audit"]), now["digest"].hexdigest(),
            ),
        )

    for c in rows:
        if now is None or c["conv"] != now["conv"]:
            if now is not None:
                yield closed()
            now = dict(c, audit=[], digest=hashlib.sha256(), begun=False, gone=0, blank=0, duplicate=0, truncated=0, illegal=0, different=0, last=None)
        for k in ("blank", "duplicate", "truncated", "illegal", "gone"):
            now[k] += c[k]
        if c["first"] is not None:
            if now["last"] is not None and now["last"] + c["first"] not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["last"] = c["last"]
        if c["different"]:
            if not now["different"]:
                now["least"], now["most"] = c["least"], c["least"] - 1
            now["different"] += c["different"] - (c["least"] == now["most"])
            now["most"] = c["most"]
        now["audit"].append(c["audit"])
        if c["has_lines"]:
            if now["begun"]:
                now["digest"].update(b"\n")
            now["digest"].update(c["repaired"].encode())
            now["begun"] = True
    if now is not None:
        yield closed()


def _sorted_by(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _in_chunks(chunks: DataFrame) -> DataFrame:
    """Conversations that are, or may be, spread over several chunks: conv (the id as text, null as
    empty, else with a mark in front) and the result."""
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    own = Window.partitionBy("conv")
    places = chunks.select(conv.alias("conv"), "part", "no").select(  # one narrow row a chunk
        "part", "no", F.row_number().over(own.orderBy("part", "no")).cast("long").alias("place"), F.count(F.lit(1)).over(own).alias("of")
    )
    placed = written(chunks.withColumn("conv", conv).join(places, ["part", "no"]).drop("alone", "conv_id", "part", "no"), "repair-placed")
    first = "conv string, place long, row int, role string, digest binary"
    said = placed.select("conv", "place", "roles", "texts", "copies").mapInArrow(_by_rows(_first_rows, _schema(first)), first)
    fresh = said.groupBy("conv", "role", "digest").agg(F.min(F.struct("place", "row")).alias("_at")).groupBy(
        "conv", F.col("_at.place").alias("place")
    ).agg(F.collect_list("_at.row").alias("fresh"))  # at most the rows of a chunk
    known = written(placed.join(fresh, ["conv", "place"], "left"), "repair-fresh")
    summaries = written(known.drop("turns").mapInArrow(_by_rows(_summaries, _schema(_SUMMARY)), _SUMMARY), "repair-codes")
    passes = converged(summaries)
    runs = passes[0]
    for later in passes[1:]:
        runs = runs.union(later)
    chosen = _sorted_by(runs, F.desc("place")).mapInArrow(_by_rows(_stitched, _schema(_CHOSEN)), _CHOSEN)
    entered = _sorted_by(chosen, "place").mapInArrow(_by_rows(_entered, _schema(_ENTERED)), _ENTERED)
    traced = known.join(entered, ["conv", "place"]).mapInArrow(_by_rows(_traced, _schema(_TRACED), 16), _TRACED)
    out = f"conv string, {_RESULT}"
    return _sorted_by(traced, "place").mapInArrow(_by_rows(_joined, _schema(out), 16), out)


def repair_conversations(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, copies; other columns are not
    looked at): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `copies` is how often a row stands there; 0 only says that there is such a conversation. Null
    roles and texts are one space, null turns come first, rows of one turn are ordered by role and
    text, and a null conv_id is a conversation of its own. Without rows all numbers are zero and the
    texts empty. An empty table gives an empty one.
    """
    workers_ready(rows.sparkSession)
    chunks = _chunked(rows, chunk_rows, chunk_bytes)
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_one_chunk(row) for row in batch.drop_columns(["conv_id"]).to_pylist()]
            found = pa.RecordBatch.from_pylist(made, _schema(_RESULT))
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], ["conv_id", *found.schema.names])

    small = chunks.filter("alone").select("conv_id", "turns", "roles", "texts", "copies").mapInArrow(alone, f"conv_id {kind}, {_RESULT}")
    large = _in_chunks(chunks.filter("NOT alone"))
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30).cast(kind))
    return small.unionByName(large.withColumn("conv_id", conv_id).drop("conv"))


def damaged(turns: DataFrame) -> DataFrame:
    """The given rows after damage that a checksum of `conv_id:turn` decides on, with `copies`. Nulls
    count as one space."""
    text, role, conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role", "conv_id", "turn"))
    h = F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20
    changed = F.when(h == 1, F.lit("")).when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return turns.select(
        "conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(role).alias("role"), changed.alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
