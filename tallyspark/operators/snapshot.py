"""Business health labels and the one-document snapshot of the headline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KPI_NAMES = [
    "dau", "wau", "mau", "growth_rate", "retention_rate", "churn_rate", "total_revenue", "arpu",
    "n_users",
]


def business_health(kpis: DataFrame) -> DataFrame:
    """Strong / Stable / Weak labels, the risk level and the alert level of a KPI row. The
    revenue label follows the growth rate."""

    def graded(value: Column, strong: float, stable: float) -> Column:
        return F.when(value >= strong, "Strong").when(value >= stable, "Stable").otherwise("Weak")

    growth, kept, churn = F.col("growth_rate"), F.col("retention_rate"), F.col("churn_rate")
    return kpis.select(
        graded(growth, 5, -5).alias("growth"),
        graded(kept, 50, 30).alias("retention"),
        graded(growth, 3, -3).alias("revenue"),
        F.when(churn < 25, "Low").when(churn < 40, "Medium").otherwise("High").alias("risk"),
        F.when(churn >= 40, "danger").when(churn >= 25, "warning").otherwise("info").alias("alert"),
    )


def _unpivot(df: DataFrame, cells: list[tuple[Column, str, str]]) -> DataFrame:
    """One (section, name, value, label) row per (section, name, column) cell."""
    entries = [
        F.struct(
            section.alias("section"), F.lit(name).alias("name"),
            F.col(column).cast("double").alias("value"), F.lit(None).cast("string").alias("label"),
        )
        for section, name, column in cells
    ]
    return df.select(F.inline(F.array(*entries)))


def _labelled(df: DataFrame, section: str, name: Column, label: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), name.alias("name"),
        F.lit(None).cast("double").alias("value"), label.alias("label"),
    )


def metrics_snapshot(
    kpis: DataFrame, stages: DataFrame, summary: DataFrame, segments: DataFrame, drivers: DataFrame
) -> DataFrame:
    """Long form (section, name, value, label): KPIs, funnel, segments, churn and its top drivers."""
    stage_numbers = ["users", "conversion_from_prev_pct", "conversion_from_top_pct", "dropoff_pct"]
    segment_numbers = [
        "users", "avg_clv", "total_revenue", "avg_orders", "avg_sessions", "churn_rate",
        "revenue_share_pct",
    ]
    top = drivers.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(3)
    stage, segment = F.concat(F.lit("stage:"), "stage"), F.concat(F.lit("segment:"), "segment")
    kpi_cells = [(F.lit("kpis"), n, n) for n in KPI_NAMES]
    parts = [
        _unpivot(kpis, [*kpi_cells, (F.lit("churn"), "rate", "churn_rate")]),
        _labelled(summary, "funnel", F.lit("largest_dropoff_stage"), F.col("largest_dropoff_stage")),
        _unpivot(
            summary, [(F.lit("funnel"), n, n) for n in ("largest_dropoff_pct", "overall_conversion")]
        ),
        _unpivot(stages, [(stage, n, n) for n in stage_numbers]),
        _unpivot(segments, [(segment, n, n) for n in segment_numbers]),
        _labelled(top, "churn", F.lit("top_driver"), F.col("feature")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def snapshot_json(
    kpis: DataFrame, stages: DataFrame, summary: DataFrame, segments: DataFrame, drivers: DataFrame
) -> DataFrame:
    """The same as one JSON document. Stages, segments and drivers are a handful of rows each."""

    def listed(df: DataFrame, order: Column, columns: list[str], name: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(order.alias("_o"), *columns)))
        return df.agg(F.transform(packed, lambda r: r.dropFields("_o")).alias(name))

    top = drivers.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(3)
    stage_list = listed(stages, F.col("stage_no"), [c for c in stages.columns if c != "stage_no"], "stages")
    segment_list = listed(segments, -F.col("total_revenue"), segments.columns, "segments")
    names = top.agg(
        F.array_sort(F.collect_list(F.struct((-F.abs("correlation")).alias("_o"), "feature"))).alias("d")
    ).select(F.transform("d", lambda r: r["feature"]).alias("top_drivers"))
    row = kpis
    for part in (summary, stage_list, segment_list, names):
        row = row.crossJoin(F.broadcast(part))
    return row.select(
        F.to_json(
            F.struct(
                F.struct(*KPI_NAMES).alias("kpis"),
                F.struct(
                    "largest_dropoff_stage", "largest_dropoff_pct", "overall_conversion", "stages"
                ).alias("funnel"),
                "segments",
                F.struct(F.col("churn_rate").alias("rate"), "top_drivers").alias("churn"),
            )
        ).alias("snapshot")
    )


_STAGE_NUMBERS = ("users", "conversion_from_prev_pct", "conversion_from_top_pct", "dropoff_pct")
_SEGMENT_NUMBERS = (
    "users", "avg_clv", "total_revenue", "avg_orders", "avg_sessions", "churn_rate", "revenue_share_pct",
)


def snapshot_values(documents: DataFrame) -> DataFrame:
    """The long form (section, name, value, label) read back from `snapshot_json` documents."""

    def fields(names) -> str:
        return ", ".join(f"{n}: double" for n in names)

    shape = (
        f"struct<kpis: struct<{fields(KPI_NAMES)}>, "
        "funnel: struct<largest_dropoff_stage: string, largest_dropoff_pct: double, "
        f"overall_conversion: double, stages: array<struct<stage: string, {fields(_STAGE_NUMBERS)}>>>, "
        f"segments: array<struct<segment: string, {fields(_SEGMENT_NUMBERS)}>>, "
        "churn: struct<rate: double, top_drivers: array<string>>>"
    )
    read = documents.select(F.from_json("snapshot", shape).alias("s")).select("s.*")

    def cell(section: Column, name: str, value: Column | None = None, label: Column | None = None) -> Column:
        return F.struct(
            section.alias("section"), F.lit(name).alias("name"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if label is None else label).cast("string").alias("label"),
        )

    def listed(array: str, prefix: str, key: str, names) -> Column:
        section = lambda r: F.concat(F.lit(prefix), r[key])
        return F.flatten(F.transform(array, lambda r: F.array(*[cell(section(r), n, r[n]) for n in names])))

    kpis, found, churn = F.lit("kpis"), F.lit("funnel"), F.lit("churn")
    single = F.array(
        *[cell(kpis, n, F.col(f"kpis.{n}")) for n in KPI_NAMES],
        cell(found, "largest_dropoff_stage", label=F.col("funnel.largest_dropoff_stage")),
        *[cell(found, n, F.col(f"funnel.{n}")) for n in ("largest_dropoff_pct", "overall_conversion")],
        cell(churn, "rate", F.col("churn.rate")),
    )
    drivers = F.transform("churn.top_drivers", lambda d: cell(churn, "top_driver", label=d))
    parts = F.concat(
        single, listed("funnel.stages", "stage:", "stage", _STAGE_NUMBERS),
        listed("segments", "segment:", "segment", _SEGMENT_NUMBERS), drivers,
    )
    return read.select(F.inline(parts))
