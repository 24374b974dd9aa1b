import datetime as dt

from tallyspark.operators import clean
from tallyspark.sources.schema import EVENT_TYPES

T0 = "2019-10-01 00:00:00 UTC"


def test_unreadable_and_missing_values_drop_the_row(events_of):
    events = events_of(
        [
            (T0, "view", 1, 1, "s"),
            ("not a time", "view", 1, 2, "s"),
            (None, "view", 1, 3, "s"),
            (T0, None, 1, 4, "s"),
            (T0, "view", None, 5, "s"),
            (T0, "view", 1, None, "s"),
            (T0, "click", 1, 7, "s"),
            (T0, "View", 1, 8, "s"),
        ]
    )
    assert [r["user_id"] for r in events.collect()] == [1]


def test_times_are_utc_and_calendar_follows(events_of):
    row = events_of([("2019-10-01 23:30:00 UTC", "view", 1, 1, "s")]).first()
    assert row["event_date"] == dt.date(2019, 10, 1)
    assert row["event_month"] == "2019-10"


def test_labels_are_filled_lowered_and_trimmed(events_of, rows_of):
    rows = rows_of(
        events_of(
            [
                (T0, "view", 1, 1, None, 1.0, None, None),
                (T0, "view", 1, 2, "s", 1.0, "  AcMe\t", "A.B.C"),
                (T0, "view", 1, 3, "s", 1.0, "x", " Odd "),
                (T0, "view", 1, 4, "s", 1.0, "x", "a."),
            ]
        ),
        "user_id",
    )
    assert (rows[1]["brand"], rows[1]["category_code"], rows[1]["user_session"]) == (
        "unknown", "unknown", "no_session",
    )
    assert (rows[1]["category"], rows[1]["subcategory"]) == ("unknown", "unknown")
    assert rows[2]["brand"] == "acme"
    assert (rows[2]["category"], rows[2]["subcategory"]) == ("a", "b.c")
    assert rows[3]["category_code"] == " odd "  # the code is not trimmed
    assert rows[4]["subcategory"] == ""


def test_prices(spark):
    frame = spark.createDataFrame(
        [("12.5",), ("n/a",), ("-3",), (None,), ("NaN",)], "price string"
    )
    assert [r["price"] for r in clean.coerce_price(frame).collect()] == [12.5, 0, 0, 0, 0]


def test_dedup_ignores_price_and_keeps_the_lowest(events_of):
    events = events_of(
        [(T0, "view", 1, 1, "s", p, b) for p, b in ((9.0, "z"), (5.0, "b"), (5.0, "a"))]
        + [(T0, "cart", 1, 1, "s", 9.0)]
    )
    kept = {r["event_type"]: (r["price"], r["brand"]) for r in events.collect()}
    assert kept == {"view": (5.0, "a"), "cart": (9.0, "acme")}


def test_quality_report(raw_of):
    raw = raw_of(
        [
            (T0, "view", 1, 1, "s", 1.0, None, None),
            (T0, "view", 1, 1, "s", 1.0, None, "a"),
            (T0, "view", 2, 1, "s"),
        ]
    )
    report = clean.data_quality_report(raw, clean.clean_events(raw))
    assert {r["metric"]: r["value"] for r in report.collect()} == {
        "raw_rows": 3, "clean_rows": 2, "rows_dropped": 1, "pct_dropped": 33.33,
        "null_brand_filled": 2, "null_category_filled": 1,
    }


def test_quality_report_without_rows(raw_of):
    raw = raw_of([])
    report = clean.data_quality_report(raw, clean.clean_events(raw))
    assert {r["value"] for r in report.collect()} == {0.0}


def test_vocabulary_is_a_subset(events_of):
    events = events_of([(T0, k, 1, i, "s") for i, k in enumerate([*EVENT_TYPES, "signup"])])
    assert {r["event_type"] for r in events.collect()} == set(EVENT_TYPES)


def test_unreadable_prices_count_as_zero(spark):
    frame = spark.createDataFrame(
        [("inf",), ("Infinity",), ("-Infinity",), ("NaN",), ("1e15",), ("x",), (None,), ("-3",), ("12000000000.25",)], "price string"
    )
    got = [r["price"] for r in clean.coerce_price(frame).collect()]
    assert got == [0.0] * 8 + [12000000000.25]


def test_quality_in_one_pass_equals_two(raw_of):
    raw = raw_of(
        [
            (T0, "view", 1, 1, None, 1.0, None, None), (T0, "view", 1, 1, "no_session", 2.0), (T0, "view", 1, 1, "s", 1.0, None),
            ("not a time", "view", 1, 2, "s"), (None, None, None, None, None), (T0, "click", 1, 7, "s"), (T0, None, 1, 7, "s"),
            *[(T0, "cart", 5, 5, "s")] * 4,
        ]
    )
    both = clean.data_quality_report(raw).collect(), clean.data_quality_report(raw, clean.clean_events(raw)).collect()
    assert both[0] == both[1] and {r["metric"]: r["value"] for r in both[0]}["clean_rows"] == 3
    empty = raw.limit(0)
    assert clean.data_quality_report(empty).collect() == clean.data_quality_report(empty, clean.clean_events(empty)).collect()
