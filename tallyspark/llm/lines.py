"""Line de-duplication by a segment-partition edit join, in DataFrame functions only.

Two lines within `edits` edits agree on at least one of the edits + 1 segments that the shorter one
is cut into, at a place that shifts by the edits around it at most. So a line is indexed under its
segments (with its length and the segment's number), and a line that may be up to `edits` longer
probes the substrings that can match: the multi-match-aware positions of the published method.

Lines that meet under a key are compared in blocks of bounded size, without a row for each pair; a
block gives the links that hold its components together. Within a component the lines are then taken
by their first place: one goes if it is itself near an earlier line that stays, so no chain of edits
takes a line away for one that is far from it. The check strips what two lines share at
both ends, then runs a bit-parallel edit distance over the band of 2 * edits + 1 diagonals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import marked, possibly, split_by_marks, whole_text
from tallyspark.llm.graph import components
from tallyspark.plans.shared import written

#: Lines within so many edits are the same line, one for every `UNIT` code points of the shorter one:
#: 0 under 20 code points (equal lines only), 1 from 20, 2 from 40 on. Two edits make anything of a
#: short line; what one edit in twenty code points loses is in the README.
EDITS, UNIT = 2, 20
#: Lines of fewer code points (without outer white space) are never dropped: only empty ones.
MIN_CHARS = 1
#: Lines compared together: a key with more is cut into blocks, and each pair of blocks is a group.
BLOCK = 64
_SPACES = " \t\n\x0b\x0c\r"


def _line_id(line: Column) -> Column:
    """128 bits of a digest: the identity of a line."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, no (from 0) and line (trimmed) of every line."""
    lines = docs.select(
        F.col(id_column).alias("doc_id"), F.posexplode(F.split(whole_text(text_column), "\n")).alias("no", "line")
    )
    return lines.withColumn("line", F.trim(F.col("line"), F.lit(_SPACES)))


def _segments(n: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of the edits + 1 even segments of a line of n code points; the
    longer ones come last."""
    k = edits + 1
    base, longer = F.floor(n / k).cast("int"), (n % k).cast("int")
    plain = k - longer  # segments without the extra code point
    out = []
    for i in range(k):
        before = i * base + F.greatest(F.lit(0), F.lit(i) - plain)
        out.append((before + 1, base + F.when(F.lit(i) >= plain, 1).otherwise(0)))
    return out


def _bands(edits: int, unit: int) -> list[tuple[int, int, int | None]]:
    """(edits, least length, greatest length) of lines that are compared within so many edits."""
    least = [max(e * unit, 2 * e + 1) for e in range(1, edits + 1)]
    return [(e, n, None if e == edits else least[e] - 1) for e, n in enumerate(least, 1)]


def keys(lines: DataFrame, edits: int, unit: int) -> DataFrame:
    """(key, line64, indexed) of `lines` (line, line64, n): a line's own segments, and the substrings
    that can match a segment of a line of its length or as much shorter as that line's edits allow.
    What equals an own segment's place is not probed again. A line has more than twice as many code
    points as edits: then no segment is empty, and every shifted substring lies inside its line."""
    found = []
    for e, least, most in _bands(edits, unit):
        k = e + 1
        for shorter in range(e + 1):
            # A plan of its own for each length to meet: its few keys are compiled to a method short
            # enough for the JVM to compile in turn. All keys of a line in one expression are not.
            allowed = F.col("n") >= least + shorter if most is None else F.col("n").between(least + shorter, most + shorter)
            some = lines.filter(allowed).select("line64", "line", (F.col("n") - shorter).alias("n"))
            cuts = {f"_{name}{i}": c for i, cut in enumerate(_segments(F.col("n"), e), 1) for name, c in zip(("start", "length"), cut)}
            rows = []
            for i in range(1, k + 1):
                low = max(-(i - 1), shorter - (k - i))
                high = min(i - 1, shorter + (k - i))
                for shift in range(low, high + 1):
                    own = shorter == 0 and shift == 0
                    part = F.substring(F.col("line"), F.col(f"_start{i}") + shift, F.col(f"_length{i}"))
                    rows.append(F.struct(F.xxhash64("n", F.lit(i), part).alias("key"), F.lit(own).alias("indexed")))
            found.append(some.withColumns(cuts).select("line64", F.inline(F.array(*rows))).select("key", "line64", "indexed"))
    return reduce(DataFrame.unionByName, found)


#: Bits of a line's short hash. It only says which lines meet: lines that share one are told apart by id.
LINE_BITS = 47


def line_hash(id_: Column) -> Column:
    return F.xxhash64(id_).bitwiseAND((1 << LINE_BITS) - 1)


def coded_keys(lines: DataFrame, edits: int, unit: int) -> DataFrame:
    """`keys` in the two numbers that are shuffled: key, and code, the line's short hash with the
    indexed bit behind it. Its upper bytes are 0, so a row is 14 bytes that do not compress."""
    found = keys(lines, edits, unit)
    return found.select("key", F.shiftleft("line64", 1).bitwiseOR(F.col("indexed").cast("bigint")).alias("code"))


#: Steps of the search for a shared end, in code points: lines of up to 2**25 of them.
_JUMPS = [1 << k for k in range(24, -1, -1)]


def _shared(a: Column, b: Column, limit: Column, cut) -> Column:
    """How many code points, `limit` at most, a and b share at one end; cut(s, have, n) gives the n
    code points behind the `have` already found equal there."""
    jumps = F.filter(F.array(*map(F.lit, _JUMPS)), lambda j: j <= limit)
    return F.aggregate(
        jumps,
        F.lit(0),
        lambda have, j: F.when(
            (have + j <= limit) & (cut(a, have, j) == cut(b, have, j)), have + j
        ).otherwise(have),
    )


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _banded(p: Column, t: Column, edits: int) -> Column:
    """The edit distance of two arrays of characters, or a number above `edits`. `p` is longer than
    `edits`, at least as long as `t`, and at most `edits` longer.

    Bit k of the vectors stands for diagonal k of the band; each character of `t` is one step."""
    width = 2 * edits + 1
    full = (1 << width) - 1
    bits = [1 << k for k in range(width)]
    dead = 2 * edits + F.size(t) - F.size(p)  # from here the score cannot come back

    def step(x: Column, c: Column) -> Column:
        match = F.lit(0)
        for k, bit in enumerate(bits):
            match = match + F.when(F.get(p, x["i"] + (k - edits)) == c, bit).otherwise(0)
        return _bound(match, lambda m: _bound(zero_diagonals(x, m), lambda d0: following(x, d0)))

    def zero_diagonals(x: Column, m: Column) -> Column:
        carried = (m.bitwiseAND(x["vp"]) + x["vp"]).bitwiseXOR(x["vp"])
        return carried.bitwiseOR(m).bitwiseOR(x["vn"]).bitwiseAND(full)

    def following(x: Column, d0: Column) -> Column:
        hp = x["vn"].bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(x["vp"])))
        hn = d0.bitwiseAND(x["vp"])
        down = F.shiftright(d0, 1)
        # The score follows the band's lowest diagonal until it leaves the table, then the last row,
        # which lies one bit higher at each step.
        beyond = x["i"] - (F.size(p) - edits)
        change = F.when(beyond < 0, (d0.bitwiseAND(bits[-1]) == 0).cast("int"))
        for k in range(edits):
            bit = bits[width - 2 - k]
            change = change.when(
                beyond == k, (hp.bitwiseAND(bit) != 0).cast("int") - (hn.bitwiseAND(bit) != 0).cast("int")
            )
        return F.struct(
            hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).bitwiseAND(full).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (x["score"] + change).alias("score"),
            (x["i"] + 1).alias("i"),
        )

    start = {"vp": (full << edits) & full, "vn": 0, "score": edits, "i": 0}
    return F.aggregate(
        t,
        F.struct(*[F.lit(v).alias(n) for n, v in start.items()]),
        lambda x, c: F.when(x["score"] > dead, x).otherwise(step(x, c)),
        lambda x: x["score"],
    )


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most `edits` edits apart."""
    if not edits:
        return a == b

    def compare(s: Column) -> Column:
        # What remains between the shared ends, the longer remainder first.
        rest = lambda x: F.substring(x, s["head"] + 1, F.length(x) - s["head"] - s["tail"])
        pair = F.struct(rest(a).alias("a"), rest(b).alias("b"))

        def check(m: Column) -> Column:
            longer = F.length(m["a"]) >= F.length(m["b"])
            chars = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))
            ordered = F.struct(
                chars(F.when(longer, m["a"]).otherwise(m["b"])).alias("p"),
                chars(F.when(longer, m["b"]).otherwise(m["a"])).alias("t"),
            )
            return F.when(F.greatest(F.length(m["a"]), F.length(m["b"])) <= edits, True).otherwise(
                _bound(ordered, lambda o: _banded(o["p"], o["t"], edits)) <= edits
            )

        return _bound(pair, check)

    # An edit changes one of the pieces that `a` is cut into at most, so the others are found in `b`.
    # This native test tells most pairs apart; what follows is interpreted and runs for the others.
    pieces = 2 * edits + 2

    def screened(width: Column) -> Column:
        return sum(b.contains(F.substring(a, width * i + 1, width)).cast("int") for i in range(pieces)) >= pieces - edits

    limit = F.least(F.length(a), F.length(b))
    front = lambda s, have, n: F.substring(s, have + 1, n)
    back = lambda s, have, n: F.substring(s, F.length(s) - have - n + 1, n)
    ends = _bound(
        _shared(a, b, limit, front),
        lambda head: F.struct(head.alias("head"), _shared(a, b, limit - head, back).alias("tail")),
    )
    plausible = _bound(F.ceil(F.length(a) / pieces).cast("int"), screened)
    return F.when((F.abs(F.length(a) - F.length(b)) > edits) | ~plausible, False).otherwise(_bound(ends, compare))


def near(a: Column, b: Column, edits: int, unit: int) -> Column:
    """Whether two different lines are as near as the shorter one's length allows."""
    n = F.least(F.length(a), F.length(b))
    verdict = None
    for e, least, _ in reversed(_bands(edits, unit)):
        verdict = F.when(n >= least, within(a, b, e)) if verdict is None else verdict.when(n >= least, within(a, b, e))
    return F.lit(False) if verdict is None else verdict.otherwise(False)


def _group_links(members: Column, edits: int, unit: int) -> Column:
    """Links (id pairs) that keep the components of one group of lines together. Members of two
    blocks are compared across the blocks only, and one of a pair must be indexed under the key."""

    def add(state: Column, x: Column) -> Column:
        met = F.filter(
            state["done"],
            lambda d: (d["id"] != x["id"])
            & ((x["lo"] == x["hi"]) | (d["b"] != x["b"]))
            & (d["indexed"] | x["indexed"])
            & near(d["line"], x["line"], edits, unit),
        )
        roots = F.array_distinct(F.transform(met, lambda d: d["root"]))
        return _bound(roots, lambda found: joined(state, x, found))

    def joined(state: Column, x: Column, found: Column) -> Column:
        root = F.coalesce(F.array_min(found), x["id"])
        done = F.transform(
            state["done"], lambda d: d.withField("root", F.when(F.array_contains(found, d["root"]), root).otherwise(d["root"]))
        )
        own = F.struct(
            x["id"].alias("id"), x["line"].alias("line"), x["b"].alias("b"), x["indexed"].alias("indexed"), root.alias("root")
        )
        return F.struct(
            F.concat(done, F.array(own)).alias("done"),
            F.concat(state["links"], F.transform(found, lambda r: F.struct(x["id"].alias("u"), r.alias("v")))).alias("links"),
        )

    start = F.struct(
        F.array().cast("array<struct<id:binary,line:string,b:int,indexed:boolean,root:binary>>").alias("done"),
        F.array().cast("array<struct<u:binary,v:binary>>").alias("links"),
    )
    return F.aggregate(members, start, add, lambda x: x["links"])


def edit_links(lines: DataFrame, edits: int, unit: int) -> DataFrame:
    """Links (u, v) between near lines, enough to connect all such lines. `lines` has id (binary),
    line, and no repeats."""
    texts = lines.select("id", "line", line_hash(F.col("id")).alias("line64"), F.length("line").alias("n"))
    by_key = Window.partitionBy("key")
    indexed = F.col("code").bitwiseAND(1) == 1
    # Only keys with an indexed line and another one go on. Nothing but ids is shuffled here.
    met = written(
        coded_keys(texts, edits, unit)
        .withColumn("_all", F.count(F.lit(1)).over(by_key))
        .withColumn("_indexed", F.count_if(indexed).over(by_key))
        .filter("_all > 1 AND _indexed > 0")
        .withColumn("_blocks", F.ceil(F.col("_all") / BLOCK).cast("int"))
        .select("key", F.shiftright("code", 1).alias("line64"), indexed.alias("indexed"), "_blocks"),
        "line-keys",
    )
    wanted = written(marked(met, "line64"), "line-marks")
    needed = possibly(texts, "line64", wanted).select("id", "line", "line64")
    own = F.pmod(F.xxhash64("line64"), F.col("_blocks")).cast("int")
    pairs = (
        met.withColumn("b", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("key", "line64", "indexed", "b", F.least("b", "_other").alias("lo"), F.greatest("b", "_other").alias("hi"))
    )
    groups = (
        pairs.join(needed, "line64")
        .groupBy("key", "lo", "hi")
        .agg(F.collect_list(F.struct("id", "line", "b", "indexed", "lo", "hi")).alias("_members"))
        .filter(F.size("_members") > 1)
    )
    return groups.select(F.explode(_group_links(F.col("_members"), edits, unit)).alias("l")).select("l.u", "l.v").distinct()


def line_classes(lines: DataFrame, edits: int, unit: int) -> DataFrame:
    """(id, class) of the lines (id, line) that are linked to another one; lines without a link have
    no row."""
    found = components(edit_links(lines, edits, unit)).select(F.col("u").alias("id"), F.col("v").alias("class"))
    return found.unionByName(found.select(F.col("class").alias("id"), "class").distinct())


def _leaders(members: Column, edits: int, unit: int) -> Column:
    """Sorted lines (id, line), taken one by one: `kept` lines, and `gone` ones (id, stays)."""
    line, gone = "id:binary,line:string", "id:binary,stays:binary"

    def take(state: Column, x: Column) -> Column:
        close = F.filter(state["kept"], lambda k: near(k["line"], x["line"], edits, unit))
        return _bound(
            close,
            lambda c: F.when(
                F.size(c) == 0, state.withField("kept", F.concat(state["kept"], F.array(F.struct(x["id"].alias("id"), x["line"].alias("line")))))
            ).otherwise(
                state.withField("gone", F.concat(state["gone"], F.array(F.struct(x["id"].alias("id"), c[0]["id"].alias("stays")))))
            ),
        )

    start = F.struct(F.array().cast(f"array<struct<{line}>>").alias("kept"), F.array().cast(f"array<struct<{gone}>>").alias("gone"))
    return F.aggregate(members, start, take)


def lines_near_a_kept_one(members: DataFrame, edits: int, unit: int) -> DataFrame:
    """(id, stays) of the lines that go for a near one that stays. `members` has id, line, class and
    place; lines of a class are taken by place, and one stays unless it is near an earlier one that
    stays.

    A round takes the first `BLOCK` lines of every class that is left, and then compares the class's
    other lines with those that stay of them. Most classes end in the first round; each round is a
    written table, and a large class is one block and otherwise a join, never a group."""
    salted = Window.partitionBy("class", "_salt").orderBy("place")
    first = Window.partitionBy("class").orderBy("place")
    out, left = None, written(members.select("id", "line", "class", "place"), "line-members")
    while left.limit(1).count():
        # Two steps, so that no task ranks more than 256 * BLOCK lines of a class.
        some = left.select("class", "id", "place", (F.xxhash64("id") % 256).alias("_salt")).withColumn("_r", F.row_number().over(salted))
        ahead = some.filter(F.col("_r") <= BLOCK).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= BLOCK).select("id")
        ahead = written(ahead, "line-ahead")
        blocks = left.join(ahead, "id").groupBy("class").agg(
            F.array_sort(F.collect_list(F.struct("place", "id", "line"))).alias("_m")
        )
        judged = written(blocks.select("class", _leaders(F.col("_m"), edits, unit).alias("l")), "line-leaders")
        rest = left.join(ahead, "id", "left_anti").join(judged.select("class", F.col("l.kept").alias("_kept")), "class")
        met = F.filter("_kept", lambda k: near(k["line"], F.col("line"), edits, unit))
        rest = written(rest.select("id", "line", "class", "place", F.get(met, F.lit(0))["id"].alias("stays")), "line-rest")
        now = judged.select(F.inline("l.gone")).unionByName(rest.filter("stays IS NOT NULL").select("id", "stays"))
        out = now if out is None else out.unionByName(now)
        left = rest.filter("stays IS NULL").drop("stays")
    return members.select("id", F.col("id").alias("stays")).limit(0) if out is None else out


def repeated_lines(docs: DataFrame, edits: int = EDITS, unit: int = UNIT, min_chars: int = MIN_CHARS,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, no (line number from 0) and stays (the id of the line that stays for it) of each line
    to drop: all but the first of equal lines, and all of a line that is near an earlier one that
    stays, by doc_id, then number. Null ids come last."""
    where = written(
        occurrences(docs, id_column, text_column).filter(F.length("line") >= max(1, min_chars)).select(
            "doc_id", "no", _line_id(F.col("line")).alias("id")
        ),
        "line-places",
    )
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("no").alias("c"))
    firsts = written(where.groupBy("id").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("_n")), "line-firsts")
    least = min([n for _, n, _ in _bands(edits, unit)], default=None)
    near_ones = firsts.select("id", F.col("id").alias("stays")).limit(0)
    if least is not None:
        long_ = occurrences(docs, id_column, text_column).filter(F.length("line") >= max(least, min_chars))
        lines = written(long_.groupBy("line").agg(F.lit(1).alias("_one")).select(_line_id(F.col("line")).alias("id"), "line"), "lines")
        classes = written(line_classes(lines, edits, unit), "line-classes")
        members = classes.join(lines, "id").join(firsts.select("id", "place"), "id")
        near_ones = lines_near_a_kept_one(members, edits, unit)
    # Written, so that the join below is between two plain shuffles: there adaptive execution can
    # split the partition of a line that a large share of all lines is equal to.
    verdicts = written(
        firsts.join(near_ones, "id", "left").filter("_n > 1 OR stays IS NOT NULL").select("id", F.col("place").alias("_first"), "stays"),
        "line-verdicts",
    )
    judged = where.join(verdicts, "id").filter(F.col("stays").isNotNull() | (place != F.col("_first")))
    return judged.select("doc_id", "no", F.coalesce("stays", "id").alias("stays"))


def dropped_lines(docs: DataFrame, **settings) -> DataFrame:
    """One row per document that loses lines: doc_id, dropped (their numbers, in order)."""
    return repeated_lines(docs, **settings).groupBy("doc_id").agg(F.array_sort(F.collect_set("no")).alias("dropped"))


def line_dedup(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` with repeated lines taken out of `text`, and n_chars brought up to date if
    there is such a column.

    Lines are compared without outer white space, by doc_id, then line number. A line goes if it
    equals an earlier one, or is near an earlier one that stays: at most one edit for every `unit`
    code points of the shorter line, and `edits` in all. Lines under `min_chars` always stay. A null text stays null; a text
    may become empty, its row stays. Rows that repeat an id are one document: a line number that is
    dropped is dropped in each of them. All columns are kept."""
    lost = written(dropped_lines(docs, **settings), "lines-lost")
    lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("dropped").alias("_lost"))
    # Texts that surely lose nothing are not shuffled.
    marks = written(marked(lost, F.xxhash64("_lost_id")), "lines-lost-marks")
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*docs.columns).alias("_row"))
    sure, unsure = split_by_marks(rows, F.xxhash64("_id"), marks)
    joined = unsure.join(lost, F.col("_id").eqNullSafe(F.col("_lost_id")), "left")
    kept = F.array_join(
        F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains(F.col("_lost"), i)), "\n"
    )
    untouched = F.col("_lost").isNull() | F.col("_row.text").isNull()
    changed = joined.select(
        F.when(untouched, F.col("_row.text")).otherwise(kept).alias("_text"), untouched.alias("_same"), "_row"
    )
    columns = []
    for c in docs.columns:
        own = F.col("_row").getField(c)
        if c == "text":
            own = F.col("_text")
        elif c == "n_chars":
            # What the given column says of rows that keep all their lines stays as it is.
            own = F.when(F.col("_same"), own).otherwise(F.length("_text")).cast(docs.schema[c].dataType)
        columns.append(own.alias(c))
    return sure.select("_row.*").unionByName(changed.select(*columns))


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """One row per given row: doc_id, n_lines, n_dropped, dropped (line numbers from 0). A null text
    has one empty line, as an empty text has."""
    lost = dropped_lines(docs, **settings).withColumnRenamed("doc_id", "_lost_id")
    counted = docs.select("doc_id", F.size(F.split(whole_text("text"), "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(lost, F.col("doc_id").eqNullSafe(F.col("_lost_id")), "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped"),
    )
