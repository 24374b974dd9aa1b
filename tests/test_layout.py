"""Layouts for slicing: same answers, fewer rows read, no shuffle by user."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import filters
from tallyspark.plans import layout
from tallyspark.plans.mart import mart
from tallyspark.plans.shared import new_path
from tallyspark.queries import FILTER

from conftest import SMALL


def _sorted(frame):
    return sorted(map(str, frame.collect()))


def _scanned(frame):
    """Rows that came out of the file scans of a frame that was run."""
    frame.write.format("noop").mode("overwrite").save()
    plan = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    rows = 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            rows += node.metrics().apply("numOutputRows").value()
        elif "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    return mart(spark, SMALL)


def test_clustered_events_are_the_events(tables):
    assert tables.clustered.dtypes == tables.events.dtypes
    assert _sorted(tables.clustered) == _sorted(tables.events)


def test_row_groups_are_skipped(spark, tables):
    path = new_path(spark, "test-clustered")
    events = tables.events.withColumn("event_month", F.lit("1996-01"))  # months of the small tables are a file each
    layout.write_clustered(events, path, values=50, row_group=4096)
    found = spark.read.schema(events.schema).parquet(path)
    one = filters.Filters(categories=("promo",), brands=("brand#3",))
    got = filters.filter_events(found, one)
    assert _sorted(got) == _sorted(filters.filter_events(events, one))
    assert 0 < got.count() <= _scanned(got) < tables.events.count() / 2
    # A brand between the others lies inside smallest and largest value of some row group.
    assert _scanned(filters.filter_events(found, filters.Filters(brands=("brand#3x",)))) == 0


def test_bloom_filters_where_a_dictionary_does_not_hold_the_values(spark, events_of):
    rows = [(f"2024-01-{1 + i % 28:02} 10:00:00", "view", 1, i, f"s{i}", 5.0, f"b{i * 7919 % 100003}") for i in range(2000)]
    path = new_path(spark, "test-bloom")
    layout.write_clustered(events_of(rows), path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = spark.read.parquet(path).inputFiles()[0]
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    chunks = {c.getPath().toDotString(): c for c in reader.getFooter().getBlocks().get(0).getColumns()}
    assert chunks["brand"].getBloomFilterOffset() > 0
    reader.close()


def test_semi_joins_without_exchange(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        seen = filters.filter_events(tables.slices, FILTER)
        for frame in (filters.filtered_users(tables.users, seen, FILTER), filters.filtered_sessions(tables.sessions, seen)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Exchange" not in plan
            assert "Bucketed: true" in plan and "PushedFilters: [" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("limits", [
    {}, {"brands": ("brand#2",)}, {"start": dt.date(1997, 1, 1), "end": dt.date(1997, 1, 31)},
    {"categories": ("promo",), "min_revenue": 50000.0}, {"brands": ("none such",)},
])
def test_slices_find_the_users_of_the_events(tables, limits):
    f = filters.Filters(**limits)
    seen, events = (filters.filter_events(t, f) for t in (tables.slices, tables.events))
    assert _sorted(filters.filtered_users(tables.users, seen, f)) == _sorted(filters.filtered_users(tables.users, events, f))
    assert _sorted(filters.filtered_sessions(tables.sessions, seen)) == _sorted(filters.filtered_sessions(tables.sessions, events))


def test_slices_sum_to_the_events(tables):
    assert tables.slices.agg({"n_events": "sum"}).first()[0] == tables.events.count()


def test_a_value_with_a_third_of_all_rows_is_cut_over_files(spark, events_of):
    rows = [(f"2024-01-{1 + i % 28:02} 10:00:{i % 60:02}", "view", 1, i, f"s{i}", 5.0, "hot" if i % 3 else f"b{i}")
            for i in range(900)]
    path = new_path(spark, "test-hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join these small parts
    try:
        layout.write_clustered(events_of(rows), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = spark.read.parquet(path).filter("brand = 'hot'")
    assert hot.count() == 600 and hot.selectExpr("_metadata.file_path").distinct().count() > 1


def test_empty_events(spark, tables):
    none = tables.events.limit(0)
    assert layout.clustered(none, "test-none").count() == 0
    assert layout.bucketed(layout.user_slices(none), "test-no-slices", 8, layout.SLICED_BY).count() == 0


def test_bucket_count_follows_the_rows():
    assert [layout.bucket_count(n) for n in (0, 16_000_000, 16_000_001, 10**11)] == [8, 8, 16, 65536]
