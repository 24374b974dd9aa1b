"""Mixing sources to target weights by Pareto order sampling.

A document's certain whole copies are allocated first. What is left of a source's target is filled
by an order sample: each document draws a uniform number from its id, documents rank by the odds of
that number divided by the odds of their inclusion probability, and the ranking is taken up to the
sample's size. The size is fixed in words, so a source's words miss its target by half a document
at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD_CLASS, whole_text
from tallyspark.plans.shared import written

#: Rank bins: a source's ranking is cut at a bin first, and only that bin's documents are ordered.
BINS = 4096


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) from a key, the same on every run: 52 bits of a digest, plus a half."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], limit: int) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, take the weights in turn;
    a target above `limit` times its source's size stops there, and the excess is shared anew by
    weight. In closed form: sources sorted by limit/weight stop in that order, so the level of the
    others follows from running sums. One row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place - 1) % len(weights) + 1)
    weighed = by_source.select("source", "source_size", weight.alias("_w")).withColumn("_cap", limit * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "source")
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(share)
    stepped = weighed.select(
        "*",
        wanted.alias("_wanted"),
        F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_from"),
    ).withColumn("_stops", (F.col("_wanted") - F.col("_before")) * F.col("_w") >= F.col("_cap") * F.col("_from"))
    left = F.col("_wanted") - F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))).over(everything), F.lit(0))
    level = left / F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(everything)
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)
    return stepped.select("source", "source_size", target.alias("target"))


def pareto_rank(u: Column, probability: Column) -> Column:
    """odds(u) / odds(probability), brought into (0, 1) by x / (1 + x); for 0 < probability < 1."""
    ratio = (u / (1 - u)) / (probability / (1 - probability))
    return ratio / (1 + ratio)


def mix_plan(sizes: DataFrame, share: float, weights: tuple[int, ...], limit: int, salt: str) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies of every document), rest (words
    still to sample), cut_bin, and last (rank, doc_id and size of the last document of the sample's
    last bin; null if that bin gives none)."""
    plan = targets(sizes, share, weights, limit)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    plan = written(plan, "mix-plan")
    ranked = _ranked(sizes, plan, salt).filter("_rank IS NOT NULL")
    # Sums of each bin, then the bin in which a source's ranking is cut: at most BINS rows a source.
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = written(
        ranked.groupBy("source", "_bin", "rest").agg(F.sum("size").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .filter("_before < rest")
        .groupBy("source").agg(F.max(F.struct("_bin", "_before")).alias("_cut"))
        .select(F.col("source").alias("_source"), F.col("_cut._bin").alias("cut_bin"), F.col("_cut._before").alias("_before")),
        "mix-cut",
    )
    at_cut = ranked.join(
        cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("cut_bin"))
    )
    inside = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # In the order of the ranking, a document is taken if more than half of it still fits.
    upto = F.col("_before") + F.sum("size").over(inside)
    last = (
        at_cut.withColumn("_taken", upto - F.col("size") / 2 < F.col("rest"))
        .groupBy("source", "cut_bin")
        .agg(F.max(F.when(F.col("_taken"), F.struct("_rank", "doc_id", "size"))).alias("last"))
        .withColumnRenamed("source", "_source")
    )
    return written(
        plan.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-cuts"
    )


def _ranked(sizes: DataFrame, plan: DataFrame, salt: str) -> DataFrame:
    """The rows with their source's plan, _rank (null if nothing is sampled) and _bin. The plan has
    one row per source; whether it is small enough to broadcast is left to the session's limit."""
    by = plan.withColumnRenamed("source", "_source")
    joined = sizes.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rank = pareto_rank(uniform(F.col("doc_id"), salt), F.col("rest") / F.col("source_size"))
    return joined.withColumn(
        "_rank", F.when((F.col("source_size") > 0) & (F.col("rest") > 0), rank)
    ).withColumn("_bin", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1)))


def _sized() -> Column:
    return F.regexp_count(whole_text("text"), F.lit(WORD_CLASS)).cast("long")


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = (5, 2, 1),
    limit: int = 2,
    salt: str = "|mix",
) -> DataFrame:
    """One row per given row: doc_id, source, size (words), source_size, target, copies.

    A null text has size 0, a null source is a source of its own. Rows that repeat an id draw the
    same number; those that repeat the size as well share their verdict. A source without words
    gets target 0 and no copies. An empty table gives no rows; other columns are not looked at.
    """
    sizes = written(docs.select("doc_id", "source", _sized().alias("size")), "mix-sizes")
    plan = mix_plan(sizes, share, weights, limit, salt)
    return _copies(sizes, plan, salt).select("doc_id", "source", "size", "source_size", "target", "copies")


def _copies(rows: DataFrame, plan: DataFrame, salt: str) -> DataFrame:
    placed = _ranked(rows, plan, salt)
    extra = (F.col("_bin") < F.col("cut_bin")) | (
        (F.col("_bin") == F.col("cut_bin")) & (F.struct("_rank", "doc_id", "size") <= F.col("last"))
    )
    return placed.withColumn("copies", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))


def mixed_documents(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = (5, 2, 1),
    limit: int = 2,
    salt: str = "|mix",
) -> DataFrame:
    """The mixed documents themselves in the given columns, each row as often as `mix` takes it.

    Texts are not shuffled: a row's copies follow from its id, its size and its source's plan."""
    sizes = written(docs.select("doc_id", "source", _sized().alias("size")), "mix-sizes")
    plan = mix_plan(sizes, share, weights, limit, salt)
    rows = docs.select("doc_id", "source", _sized().alias("size"), F.struct(*docs.columns).alias("_row"))
    taken = _copies(rows, plan, salt).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
