"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule names the measures of a text that it looks at. Its cost, from the text to the verdict, and its
selectivity are estimated on a bounded sample; rules then run in order of rejections per second. A row that
one rule rejects reaches no later rule, and a measure is computed when the first rule that
needs it runs, on the rows that reach that rule: it is null for the others. The order changes
the work, never the verdict. A caller who wants all measures of all rows pays for these first, and what
is left to the cascade are the measures that only rules look at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE_CLASS, whole_text
from tallyspark.plans.shared import written

#: Rows the costs are estimated on, at most. They are the first rows read, so that planning never
#: costs a pass over the table; a biased sample can only make the order slower.
SAMPLE_ROWS = 500
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on the measures named in `needs`, or on anything computed from _text."""

    name: str
    rejects: Column
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    """How a column follows from _text and from the measures it needs."""

    of: Callable[[], Column]
    needs: tuple[str, ...] = ()


def _repeated_words(words: Column, n_words: Column) -> Column:
    """Words inside windows that occur at least twice in the text, the first occurrence included.

    Windows are compared by 64-bit hashes. Texts without a repeated window, the usual case, end
    after one hash set; the others sort their windows."""
    windows = F.transform(
        F.sequence(F.lit(0), n_words - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )

    def covered(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        shared = F.transform(
            F.array(placed),  # binds the sorted windows to a name
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )[0]
        return F.aggregate(
            shared,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")),
            lambda a: a["n"],
        )

    return F.when(n_words < WINDOW, 0).otherwise(
        F.transform(
            F.array(windows),
            lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found)),
        )[0]
    )


def _count(pattern: str) -> Column:
    return F.regexp_count("_text", F.lit(pattern)).cast("long")


#: Measures by name, each after those it needs.
MEASURES = {
    "_words": Measure(lambda: F.array_remove(F.split("_text", SPACE_CLASS), "")),
    "_lines": Measure(lambda: F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "n_symbols": Measure(lambda: _count(SYMBOLS)),
    "n_capitals": Measure(lambda: _count(r"\p{Lu}")),
    "n_letters": Measure(lambda: _count(r"\p{L}")),
    "n_words": Measure(lambda: F.size("_words").cast("long"), ("_words",)),
    "word_chars": Measure(lambda: F.length(F.array_join("_words", "")).cast("long"), ("_words",)),
    "n_lines": Measure(lambda: F.size("_lines").cast("long"), ("_lines",)),
    "n_dup_lines": Measure(
        lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), ("_lines",)
    ),
    "n_repeat_words": Measure(lambda: _repeated_words(F.col("_words"), F.size("_words")).cast("long"), ("_words",)),
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _with_measures(rows: DataFrame, names: Iterable[str], wanted: Column | None = None) -> DataFrame:
    """Rows with the measures they lack, and those these need; null where `wanted` is not true."""
    asked, lacking = list(names), set()
    while asked:
        name = asked.pop()
        if name not in rows.columns and name not in lacking:
            lacking.add(name)
            asked += MEASURES[name].needs
    for of_text in (True, False):  # what comes from the text alone, then the others
        columns = {
            name: m.of() if wanted is None else F.when(wanted, m.of())
            for name, m in MEASURES.items()
            if name in lacking and bool(m.needs) != of_text
        }
        rows = rows.withColumns(columns) if columns else rows
    return rows


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("_text"))


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, _text, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    rows = _with_measures(texts(docs, id_column, text_column), BASE_MEASURES)
    return rows.select("doc_id", "_text", *BASE_MEASURES)


def default_rules() -> list[Rule]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("few_words", words < 10, ("n_words",)),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 20 * words, ("n_repeat_words", "n_words")),
        Rule("symbols", 10 * F.col("n_symbols") > words, ("n_symbols", "n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), ("n_dup_lines", "n_lines")),
        Rule("word_length", (chars < 2 * words) | (chars > 20 * words), ("word_chars", "n_words")),
        Rule("capitals", 2 * F.col("n_capitals") > F.col("n_letters"), ("n_capitals", "n_letters")),
        Rule("letters", 2 * F.col("n_letters") < chars, ("n_letters", "word_chars")),
    ]


BASE_RULES = ("few_words", "repeated_words")


def ordered_rules(rows: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second, estimated on at most `sample_rows` rows of _text. A
    rule's time includes its measures, but for those that the rows already have."""
    sample = written(rows.limit(sample_rows), "rule-sample")

    def timed(frame: DataFrame) -> tuple[float, int]:
        seconds = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            found = frame.first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), found

    reading, _ = timed(sample.agg(F.count_if(F.length("_text") < 0)))
    worth = {}
    for rule in rules:
        seconds, rejected = timed(_with_measures(sample, rule.needs).agg(F.count_if(rule.rejects)))
        worth[rule.name] = rejected / max(seconds - reading, 1e-3)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows of _text with `rejected_by`, the first of the rules that rejects a row, null if none does. A
    measure that the rows lack is computed for a row only if the row reaches a rule that needs it."""
    rows = rows.withColumn("rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        rows = _with_measures(rows, rule.needs, F.col("rejected_by").isNull())
        verdict = F.when(rule.rejects, F.lit(rule.name))
        rows = rows.withColumn("rejected_by", F.coalesce("rejected_by", verdict))
    return rows


def quality_rules(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    measures: bool = True,
) -> DataFrame:
    """One row per given row: doc_id, with `measures` the base measures of every row, kept, and
    rejected_by (the first rule of the cascade that rejects it, null if kept).

    A null or empty text has no words and falls to `few_words`. Repeated rows are judged each for
    itself. Other columns are not looked at. The order of rules follows from measured times, so where
    several rules reject a row, `rejected_by` may be another one in a rerun; `kept` never changes.
    """
    rows = measured(docs, id_column, text_column) if measures else texts(docs, id_column, text_column)
    judged = cascade(rows, ordered_rules(rows, rules or default_rules(), sample_rows))
    return judged.select(
        "doc_id", *(BASE_MEASURES if measures else ()), F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )
