"""The written star schema behind the registered queries.

Cleaning (two joins and a de-duplication shuffle over all events) is paid once per application and
source; the cleaned events, the user-day rollup and the derived tables are written to the shared
folder as Parquet, and queries scan the columns they need from there. Each table is built on first
use from the smallest written input that has what it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import activity, bitmaps, churn, clean, models, segments, tables
from tallyspark.plans import layout
from tallyspark.plans.shared import new_path, written
from tallyspark.session import tune
from tallyspark.sources import append, store
from tallyspark.sources.adapters import click_raw, order_raw

ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "orders": order_raw,
    "clicks": click_raw,
}


class Mart:
    """Tables of one source over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, source: str):
        self.spark, self.sf_dir, self.source = spark, sf_dir, source

    def _keep(self, frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        return written(frame, f"{self.source}-{name}", by)

    @cached_property
    def _buckets(self) -> int:
        return layout.bucket_count(self.events.count())

    def _bucketed(self, frame: DataFrame, name: str, order: tuple[str, ...] = ("user_id",)) -> DataFrame:
        return layout.bucketed(frame, f"{self.source}-{name}", self._buckets, order)

    @property
    def raw(self) -> DataFrame:
        return ADAPTERS[self.source](self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return written(clean.clean_events(self.raw, to_write=True), f"{self.source}-events", by="event_month", laid_out=True)

    @cached_property
    def days(self) -> DataFrame:
        return self._keep(tables.user_days(self.events), "days")

    @cached_property
    def activity(self) -> DataFrame:
        return self._keep(activity.user_activity(self.days), "activity")

    @cached_property
    def users(self) -> DataFrame:
        return self._bucketed(tables.user_metrics(self.events), "users")

    @cached_property
    def cuts(self) -> dict[str, float | None]:
        """Where users are cut into segments."""
        return segments.segment_cuts(self.users)

    @cached_property
    def sessions(self) -> DataFrame:
        return self._bucketed(tables.session_metrics(self.events), "sessions")

    @cached_property
    def clustered(self) -> DataFrame:
        """The events again, laid out for slices by category and brand."""
        return layout.clustered(self.events, f"{self.source}-clustered")

    @cached_property
    def slices(self) -> DataFrame:
        return self._bucketed(layout.user_slices(self.events), "slices", layout.SLICED_BY)

    @cached_property
    def appended(self) -> dict[str, DataFrame]:
        """The five tables, loaded up to the last month and then given that month as a file that
        starts three days early, so that it repeats events over the month's edge."""
        folder = new_path(self.spark, f"{self.source}-appended")
        raw = self._keep(self.raw, "raw")  # read three times, joined once
        last = clean.wanted_events(raw).agg(F.date_format(F.max("event_time"), "yyyy-MM")).first()[0]
        if last is None:
            return store.etl_run(raw, folder)
        edge = F.lit(f"{last}-01").cast("timestamp")
        store.etl_run(raw.filter(F.col("event_time") < edge), folder)
        late = raw.filter(F.col("event_time") >= edge - F.expr("INTERVAL 3 DAYS"))
        return append.etl_append(late, folder)

    @cached_property
    def bitmaps(self) -> str:
        """Folder of the user bitmaps: all days but the last seven, then these added."""
        folder = new_path(self.spark, f"{self.source}-bitmaps")
        edge = self.days.agg(F.date_sub(F.max("event_date"), 6)).scalar()
        bitmaps.create_bitmaps(self.days.filter(F.col("event_date") < edge), folder)
        bitmaps.add_days(self.days.filter(F.col("event_date") >= edge), folder)
        return folder

    @cached_property
    def prepared(self) -> churn.Prepared:
        return churn.prepare(self.users)

    @cache
    def model(self, name: str) -> PipelineModel:
        """A churn model, trained once per application."""
        return churn.fit(self.prepared, name)

    @cached_property
    def newton(self) -> tuple:
        """Coefficients and scales of the logistic model by Newton's method."""
        return models.newton_logistic(self.prepared)

    @cache
    def nodes(self, name: str) -> DataFrame:
        """The node table of a tree model."""
        return self._keep(models.tree_nodes(self.model(name)), "nodes")

    @cached_property
    def compared(self) -> DataFrame:
        """All models on the held-out users."""
        return self._keep(churn.compare({name: self.scored(name) for name in churn.MODELS}), "compared")

    @cached_property
    def best(self) -> str:
        return churn.best_model(self.compared)

    @cache
    def scored(self, name: str) -> DataFrame:
        return churn.score_test(self.prepared, self.model(name))


GIVEN = {"orders": ("lineitem", "orders", "part"), "clicks": ("events", "part")}

_marts: dict[tuple, Mart] = {}


def _versions(spark: SparkSession, sf_dir: str, source: str) -> tuple:
    """Sizes and times of the given files; a listing, nothing is read."""
    paths = [f"{sf_dir}/{table}.parquet" for table in GIVEN[source]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    found = files.agg(
        F.count(F.lit(1)), F.sum("length"), F.max(F.unix_micros("modificationTime"))
    )
    return tuple(found.first())


_listed: dict[tuple, tuple] = {}


def refresh() -> None:
    """Look at the given files again at the next use: changed ones get a new mart."""
    _listed.clear()


def mart(spark: SparkSession, sf_dir: str, source: str = "orders") -> Mart:
    """The mart of this application for a folder and source. The given files are listed once, and
    again after `refresh()`."""
    tune(spark)
    folder = str(sf_dir).rstrip("/")
    place = (spark.sparkContext.applicationId, folder, source)
    if place not in _listed:
        _listed[place] = _versions(spark, folder, source)
    key = (*place, *_listed[place])
    if key not in _marts:
        _marts[key] = Mart(spark, folder, source)
    return _marts[key]
