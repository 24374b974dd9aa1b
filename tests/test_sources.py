import json

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import shared
from tallyspark.plans.joins import join_lookup
from tallyspark.plans.mart import mart
from tallyspark.queries import QUERIES
from tallyspark.sources import append, store
from tallyspark.sources.schema import DECLARED, RAW_EVENTS, TABLES, declared_columns

from conftest import SMALL

HEADER = "user_session,event_time,event_type,product_id,category_id,category_code,brand,price,user_id"


def test_csv_in_any_column_order(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        HEADER + "\n"
        "s1,2019-10-01 00:00:00 UTC,view,1,2,a.b,acme,1.5,9\n"
        ",bad time,cart,1,2,,,2.5,9\n"
    )
    events = store.read_events_csv(spark, str(path))
    assert events.columns == RAW_EVENTS.names
    rows = {r["event_type"]: r for r in events.collect()}
    assert rows["view"]["price"] == 1.5 and str(rows["view"]["event_time"]).startswith("2019-10-01")
    assert rows["cart"]["event_time"] is None and rows["cart"]["brand"] is None
    assert store.read_events_csv(spark, str(path), nrows=1).count() == 1


def test_csv_files_with_different_headers(spark, tmp_path):
    names = HEADER.split(",")
    swapped = [{"user_id": "product_id", "product_id": "user_id"}.get(n, n) for n in names]
    row = "s1,2019-10-01 00:00:00 UTC,view,1,2,a.b,acme,1.5,9\n"
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + row)
    (tmp_path / "b.csv").write_text(",".join(names) + "\n" + row)
    both = str(tmp_path / "*.csv")
    assert [(r["product_id"], r["user_id"]) for r in store.read_events_csv(spark, both).collect()] == [(1, 9)] * 2
    (tmp_path / "b.csv").write_text(",".join(swapped) + "\n" + row)
    with pytest.raises(Exception, match="(?i)header"):
        store.read_events_csv(spark, both).collect()


def test_malformed_csv_lines(spark, tmp_path):
    good = 's1,2019-10-01 00:00:00 UTC,view,1,2,"a,b",acme,1.5,9'
    bad = ["s2,2019-10-01 00:00:00 UTC,view", good + ",spare", good.replace("1.5", "n/a"), good.replace(",1,", ",x,")]
    path = tmp_path / "events.csv"
    path.write_text("\n".join([HEADER, good, *bad]) + "\n")
    found = store.malformed_lines(spark, str(path)).collect()
    assert {r["line"]: r["problem"] for r in found} == dict(
        zip(bad, ["too few fields", "too many fields", "unreadable number", "unreadable number"])
    )
    assert all(r["file"].endswith("events.csv") for r in found)
    kept = store.read_events_csv(spark, str(path), on_malformed="drop")
    assert [r["category_code"] for r in kept.collect()] == ["a,b"]
    # Whatever is selected, the same lines count as malformed.
    assert kept.count() == 1 and kept.select("brand").count() == 1 and kept.select("user_session").collect() == [("s1",)]
    assert store.read_events_csv(spark, str(path)).count() == 5
    strict = store.read_events_csv(spark, str(path), on_malformed="fail")
    for frame in (strict, strict.select("brand")):
        with pytest.raises(Exception, match="(?i)malformed"):
            frame.collect()
    path.write_text("\n".join([HEADER, good]) + "\n")
    assert store.read_events_csv(spark, str(path), on_malformed="fail").count() == 1
    assert store.malformed_lines(spark, str(path)).count() == 0
    with pytest.raises(KeyError):
        store.read_events_csv(spark, str(path), on_malformed="other")


def test_csv_with_missing_columns(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("event_time,event_type\n2019-10-01,view\n")
    with pytest.raises(ValueError, match="brand.*user_session"):
        store.read_events_csv(spark, str(path))


def test_tables_round_trip_with_month_pruning(spark, tmp_path):
    m = mart(spark, SMALL)
    folder = str(tmp_path / "tables")
    store.write_tables_parquet(store.star_schema(m.events), folder)
    frames = store.load_tables(spark, folder)
    assert dict(frames["fact_events"].dtypes)["event_month"] == "string"
    assert frames["fact_events"].count() == m.events.count()
    picked = frames["fact_events"].filter("event_month = '1998-05'")
    assert "PartitionFilters: [isnotnull(event_month" in picked._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        store.load_tables(spark, str(tmp_path / "nowhere"))


def _same(one, other):
    return {n: sorted(map(repr, one[n].collect())) for n in TABLES} == {
        n: sorted(map(repr, other[n].select(one[n].columns).collect())) for n in TABLES
    }


OLD = [
    ("2019-10-01 10:00:00", "view", 1, 7, "a", 5.0),
    ("2019-10-20 10:00:00", "purchase", 1, 7, "a", 5.0),
    ("2019-10-31 23:59:00", "view", 2, 8, "edge", 9.0, None, None),
    ("2019-10-31 23:59:30", "cart", 2, 8, "edge", 9.0),
    ("2019-10-05 00:00:00", "view", 3, 9, None, 1.0),
    ("2019-09-05 00:00:00", "view", 3, 10, "quiet", 1.0),
]
NEW = [
    ("2019-10-31 23:59:30", "cart", 2, 8, "edge", 4.0),  # a cheaper copy over the month's edge
    ("2019-10-31 23:59:00", "view", 2, 8, "edge", 9.0, "acme", None),
    ("2019-11-01 00:00:10", "purchase", 2, 8, "edge", 9.0),
    ("2019-11-03 00:00:00", "purchase", 4, 9, None, 3.0),
    ("2019-11-03 00:00:00", "purchase", 4, 9, None, 2.0),
    ("2019-11-30 00:00:00", "view", 1, 11, "late", 2.0),
    ("2019-08-01 00:00:00", "view", 5, 12, "older", 2.0),  # a month nobody had
    (None, "view", 5, 12, "older", 2.0),
]


def test_append_equals_one_run_over_all(spark, raw_of, tmp_path):
    folder, whole = str(tmp_path / "appended"), str(tmp_path / "whole")
    before = store.etl_run(raw_of(OLD), folder)
    quiet = {r["user_id"]: r for r in before["user_metrics"].collect()}[10]
    september = sorted((tmp_path / "appended/fact_events.parquet/event_month=2019-09").iterdir())
    after = append.etl_append(raw_of(NEW), folder)
    assert _same(store.etl_run(raw_of(OLD + NEW), whole), after)
    assert sorted((tmp_path / "appended/fact_events.parquet/event_month=2019-09").iterdir()) == september
    later = {r["user_id"]: r for r in after["user_metrics"].collect()}[10]
    assert later["days_since_last_seen"] > quiet["days_since_last_seen"] and later["is_churned"] == 1
    # Again, an empty feed, one without a usable event, and the derived tables made anew.
    assert _same(store.read_tables_parquet(spark, whole), append.etl_append(raw_of(NEW), folder))
    assert _same(store.read_tables_parquet(spark, whole), append.etl_append(raw_of([]), folder))
    assert _same(store.read_tables_parquet(spark, whole), append.etl_append(raw_of(NEW[-1:]), folder))
    assert _same(store.read_tables_parquet(spark, whole), store.derive_tables(spark, folder))


def test_append_that_broke_off_is_repeated(spark, raw_of, tmp_path, monkeypatch):
    folder, whole = str(tmp_path / "appended"), str(tmp_path / "whole")
    store.etl_run(raw_of(OLD), folder)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:  # the months are replaced, the derived tables are not
        patch.setattr(append, "write_tables_parquet", broken)
        with pytest.raises(RuntimeError, match="lost"):
            append.etl_append(raw_of(NEW), folder)
    assert _same(store.etl_run(raw_of(OLD + NEW), whole), append.etl_append(raw_of(NEW), folder))


def test_append_moves_no_events_for_few_sessions(spark, raw_of, tmp_path, monkeypatch):
    """The session that reaches over months is broadcast, also if the planner would not."""
    folder = str(tmp_path / "appended")
    store.etl_run(raw_of(OLD), folder)
    kept, plans = append.write_tables_parquet, []
    monkeypatch.setattr(append, "write_tables_parquet", lambda frames, to: (
        plans.append(frames["session_metrics"]._jdf.queryExecution().executedPlan().toString()), kept(frames, to)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = append.etl_append(raw_of(NEW), folder)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert _same(store.etl_run(raw_of(OLD + NEW), str(tmp_path / "whole")), after)
    assert not (tmp_path / "appended/_next/session_metrics.parquet").exists()


def test_append_to_empty_tables(spark, raw_of, tmp_path):
    folder, whole = str(tmp_path / "appended"), str(tmp_path / "whole")
    store.etl_run(raw_of([]), folder)
    assert _same(store.etl_run(raw_of(NEW), whole), append.etl_append(raw_of(NEW), folder))


def test_catalog_tables_win_over_files(spark, tmp_path):
    m = mart(spark, SMALL)
    store.create_star_schema(spark, store.star_schema(m.events), "tally_test", str(tmp_path / "db"))
    frames = store.load_tables(spark, str(tmp_path / "none"), "tally_test")
    for name in TABLES:
        kinds = [(c, k.replace(" ", "")) for c, k in declared_columns(name)]
        assert frames[name].dtypes == kinds
    assert frames["user_metrics"].count() == m.users.count()


def test_declared_columns():
    assert declared_columns("daily_activity")[-1] == ("revenue", "decimal(14,2)")
    assert [len(declared_columns(t)) for t in DECLARED] == [13, 31, 14, 10, 6]


def test_jdbc_options(monkeypatch, spark):
    seen = {}
    frame = spark.range(1)
    monkeypatch.setattr(
        type(frame.write), "jdbc",
        lambda self, url, table, mode=None, properties=None: seen.update(url=url, table=table, mode=mode, **properties),
    )
    store.write_table_jdbc(frame, "users", "jdbc:x", {"user": "u"})
    assert seen == {"url": "jdbc:x", "table": "users", "mode": "overwrite", "batchsize": "10000", "truncate": "true", "user": "u"}


def test_named_parameters(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert store.read_sql(spark, "SELECT count(*) n FROM ten WHERE id >= :low", {"low": 7}).first()["n"] == 3


def test_lookup_join_both_ways(spark):
    big = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    want = sorted(map(tuple, join_lookup(big, lookup, "k").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        large = join_lookup(big, lookup, "k")
        assert sorted(map(tuple, large.collect())) == want
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(want) == 667


def test_a_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_snapshot_is_one_document(spark):
    document = json.loads(QUERIES["snapshot_json"](spark, SMALL).first()["snapshot"])
    assert set(document) == {"kpis", "funnel", "segments", "churn"}
    assert [s["stage"] for s in document["funnel"]["stages"]][0] == "View Product"
    assert len(document["churn"]["top_drivers"]) == 3
