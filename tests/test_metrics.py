import datetime as dt
import random

from tallyspark.operators import bitmaps, cohort, metrics, tables, warehouse


def test_previous_means_previous_present_period(days_of):
    days = days_of(
        [(1, "2024-01-01"), (2, "2024-01-01"), (1, "2024-03-12"), (2, "2024-03-12"), (3, "2024-03-12"), (4, "2024-03-25"), (1, "2024-03-25")]
    )
    growth = [tuple(r) for r in metrics.monthly_growth_trend(days).collect()]
    assert growth == [("2024-01", 2, None), ("2024-03", 4, 100.0)]
    kept = [tuple(r) for r in metrics.retention_trend(days).collect()]
    assert kept[0] == ("2024-01-01/2024-01-07", None)
    assert kept[1] == ("2024-03-11/2024-03-17", 100.0)  # both came from the last present week
    assert kept[2][1] == 100.0 / 3
    lost = metrics.churn_trend(metrics.retention_trend(days)).collect()
    assert lost[0]["churn_pct"] is None and lost[1]["churn_pct"] == 0.0


def test_a_week_nobody_returns_in(days_of):
    days = days_of([(1, "2024-01-01"), (2, "2024-01-08"), (1, "2024-01-15")])
    assert [r["retention_pct"] for r in metrics.retention_trend(days).collect()] == [None, 0.0, 0.0]


def _random_days(seed, users=25, span=80):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    pairs = {
        (u, start + dt.timedelta(days=rng.randrange(span)))
        for u in range(users) for _ in range(rng.randrange(1, 9))
    }
    return sorted(pairs)


def test_rolling_users_against_brute_force(days_of):
    pairs = _random_days(1)
    got = {
        r["event_date"]: (r["dau"], r["wau"], r["mau"])
        for r in metrics.rolling_active_users(days_of([(u, d.isoformat()) for u, d in pairs])).collect()
    }
    want = {}
    for day in {d for _, d in pairs}:
        want[day] = tuple(
            len({u for u, d in pairs if 0 <= (day - d).days < length}) for length in (1, 7, 30)
        )
    assert got == want


def test_bitmaps_grown_in_loads_against_brute_force(spark, days_of, tmp_path):
    pairs = [(u * 10**15 - 9, d) for u, d in _random_days(3, users=60)]
    folder = str(tmp_path / "bits")

    def load(some):
        return days_of([(u, d.isoformat()) for u, d in some])

    cut = dt.date(2024, 2, 20)
    late = [p for i, p in enumerate(pairs) if i % 7 == 0]  # of any date, after newer ones
    first = [p for p in pairs if p not in late]
    bitmaps.create_bitmaps(load([p for p in first if p[1] < cut]), folder)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bits").rglob("*.parquet")}
    bitmaps.add_days(load([p for p in first if p[1] >= cut]), folder)
    bitmaps.add_days(load(late + first[:5]), folder)  # some a second time
    bitmaps.add_days(load([]), folder)
    assert before.items() <= {p: p.stat().st_mtime_ns for p in (tmp_path / "bits").rglob("*.parquet")}.items()

    def users(day, length):
        return len({u for u, d in pairs if 0 <= (day - d).days < length})

    want = [(day, users(day, 1), users(day, 7), users(day, 30)) for day in sorted({d for _, d in pairs})]
    assert [tuple(r) for r in bitmaps.rolling_active_users(spark, folder).collect()] == want
    recent = bitmaps.rolling_active_users(spark, folder, since=dt.date(2024, 3, 5))
    assert [tuple(r) for r in recent.collect()] == [r for r in want if r[0] >= dt.date(2024, 3, 5)]
    assert bitmaps.active_users(spark, folder, 7).first()[0] == want[-1][2]
    assert bitmaps.active_users(spark, folder, 14, cut).first()[0] == users(cut, 14)
    assert bitmaps.active_users(spark, folder, 3, dt.date(2020, 1, 1)).first()[0] == 0
    plan = bitmaps.active_users(spark, folder, 7, cut)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan


def test_bitmaps_of_nothing(spark, days_of, tmp_path):
    folder = str(tmp_path / "bits")
    bitmaps.create_bitmaps(days_of([]), folder)
    assert bitmaps.rolling_active_users(spark, folder).collect() == []
    assert bitmaps.active_users(spark, folder, 7).first()[0] == 0


def test_day_n_against_brute_force(days_of):
    pairs = _random_days(2)
    first = {}
    for u, d in pairs:
        first[u] = min(first.get(u, d), d)
    days = days_of([(u, d.isoformat()) for u, d in pairs])
    got = {r["day"]: r["retained_users"] for r in cohort.day_n_retention(days).collect()}
    want = {
        f"D{n}": len({u for u, d in pairs if (d - first[u]).days == n}) for n in (1, 7, 30, 90)
    }
    assert got == want
    wide = warehouse.sql_day_n_retention(days).first()
    assert wide["cohort_size"] == len(first)
    assert wide["d7_retention"] == round(100 * want["D7"] / len(first), 2)


def test_cohort_matrix_shapes(days_of):
    days = days_of(
        [(1, "2023-11-05"), (1, "2024-01-05"), (2, "2023-11-09"), (3, "2024-01-01"), (3, "2024-02-28")]
    )
    long = {(r["cohort"], r["month_number"]): r["retention_pct"] for r in cohort.cohort_retention(days).collect()}
    assert long == {("2023-11", 0): 100.0, ("2023-11", 2): 50.0, ("2024-01", 0): 100.0, ("2024-01", 1): 100.0}
    wide = cohort.cohort_matrix(days)
    assert wide.columns == ["cohort", "0", "1", "2"]
    assert [tuple(r) for r in wide.collect()] == [("2023-11", 100.0, None, 50.0), ("2024-01", 100.0, 100.0, None)]
    summary = cohort.cohort_summary(cohort.cohort_retention(days), cohort.day_n_retention(days)).first()
    assert (summary["best_cohort"], summary["avg_month1_retention"]) == ("2024-01", 100.0)
    assert (summary["d30_retention"], summary["status"]) == (0.0, "Weak")


def test_kpis(events_of):
    events = events_of(
        [
            ("2024-01-10 00:00:00", "view", 1, 1, "a"),
            ("2024-01-10 00:00:00", "view", 1, 2, "b"),
            ("2024-02-20 00:00:00", "purchase", 1, 1, "c", 50.0),
            ("2024-02-25 00:00:00", "view", 1, 3, "d"),
        ]
    )
    row = metrics.executive_kpis(tables.user_days(events), tables.user_metrics(events)).first()
    assert row.asDict() == {
        "dau": 1, "wau": 2, "mau": 2, "growth_rate": 0.0, "retention_rate": 50.0,
        "churn_rate": 33.33, "total_revenue": 50.0, "arpu": 16.67, "n_users": 3,
    }


def test_kpis_without_events(events_of):
    events = events_of([])
    row = metrics.executive_kpis(tables.user_days(events), tables.user_metrics(events)).first()
    assert set(row) == {0}


def test_deltas_with_one_period(events_of):
    events = events_of([("2024-01-10 00:00:00", "view", 1, 1, "a")])
    days = tables.user_days(events)
    deltas = metrics.kpi_deltas(days, metrics.revenue_trend(events), metrics.retention_trend(days))
    got = {r["kpi"]: r["delta"] for r in deltas.collect()}
    assert got == {
        "dau": 0.0, "wau": 0.0, "mau": 0.0, "growth_rate": None, "retention_rate": None,
        "churn_rate": None, "revenue": 0.0, "arpu": 0.0,
    }


def test_sparks_keep_the_last_twenty(days_of, events_of, spark):
    days = days_of([(u, f"2024-01-{d:02d}") for d in range(1, 26) for u in range(d)])
    revenue = spark.createDataFrame([], "date date, revenue double")
    sparks = metrics.kpi_sparks(days, revenue, metrics.retention_trend(days)).collect()
    dau = sorted((r["point"], r["value"]) for r in sparks if r["kpi"] == "dau")
    assert dau == [(i + 1, float(i + 6)) for i in range(20)]


def test_window_ends_are_inclusive(days_of):
    days = days_of([(1, "2024-01-01"), (2, "2024-01-07"), (3, "2024-01-08")])
    assert metrics.window_active(days, 7).first()[0] == 2
    assert metrics.window_active(days, 7, dt.date(2024, 1, 7)).first()[0] == 2
    assert metrics.window_active(days, 1, dt.date(2024, 1, 5)).first()[0] == 0
