"""Activity bits against plain sets of dates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import activity, cohort, metrics

from conftest import SMALL


def _history(seed):
    """Users with days around month, year, week-word and 1970 edges, gaps of whole weeks, and a daily one."""
    rng = random.Random(seed)
    starts = ["1969-12-20", "1999-12-25", "2000-02-27", "2024-01-29", "2024-12-30"]
    pairs = set()
    for user in range(60):
        start = dt.date.fromisoformat(rng.choice(starts))
        for _ in range(rng.choice([1, 2, 5, 40])):
            gap = rng.choice([0, 1, 2, 6, 7, 8, 30, 31, 90, 224, 365])
            pairs.add((user, start + dt.timedelta(gap + rng.randrange(3))))
    pairs |= {(99, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(500)}
    return sorted(pairs)


@pytest.fixture(scope="module")
def history(days_of):
    return lambda seed: days_of([(u, str(d)) for u, d in _history(seed)])


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_sets_of_dates(history, seed):
    by_user = {}
    for user, date in _history(seed):
        by_user.setdefault(user, set()).add(date)
    bits = activity.user_activity(history(seed)).cache()

    expected = {}
    for dates in by_user.values():
        first = min(dates)
        for year, month in {(d.year, d.month) for d in dates}:
            key = (first.replace(day=1), (year - first.year) * 12 + month - first.month)
            expected[key] = expected.get(key, 0) + 1
    assert {tuple(r)[:2]: r[2] for r in activity.cohort_activity(bits).collect()} == expected

    day_list = (1, 2, 7, 30, 31, 90)
    kept = {f"D{n}": sum(min(d) + dt.timedelta(n) in d for d in by_user.values()) for n in day_list}
    found = activity.day_n_retention(bits, day_list).collect()
    assert {r["day"]: r["retained_users"] for r in found} == kept and any(kept.values())

    pairs = {}
    for dates in by_user.values():
        mondays = sorted({d - dt.timedelta(d.weekday()) for d in dates})
        for monday, before in zip(mondays, [None, *mondays]):
            pairs[monday, before] = pairs.get((monday, before), 0) + 1
    assert {tuple(r)[:2]: r[2] for r in activity.week_pairs(bits).collect()} == pairs


def test_equal_to_the_user_day_form(history):
    days = history(3)
    bits = activity.user_activity(days)
    for new, old in [
        (cohort.retention_matrix(activity.cohort_activity(bits)), cohort.cohort_retention(days)),
        (activity.cohort_sizes(bits), cohort.cohort_sizes(days)),
        (activity.day_n_retention(bits), cohort.day_n_retention(days)),
        (activity.retention_trend(bits), metrics.retention_trend(days)),
    ]:
        assert new.dtypes == old.dtypes
        assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))


def test_merged_spans_equal_the_whole(history):
    days = history(4)
    edge = F.lit("2024-03-01").cast("date")
    late = days.filter(F.col("event_date") >= F.date_sub(edge, 40))  # overlaps the early ones
    parts = [activity.user_activity(days.filter(F.col("event_date") < edge)), activity.user_activity(late)]
    assert sorted(activity.merged(*parts).collect()) == sorted(activity.user_activity(days).collect())


def test_empty_and_unknown(spark):
    rows = spark.createDataFrame(
        [(None, dt.date(2024, 1, 1), 1), (1, None, 1)], "user_id long, event_date date, n_events long"
    )
    bits = activity.user_activity(rows)
    assert bits.count() == 0
    assert activity.cohort_activity(bits).count() == 0 and activity.retention_trend(bits).count() == 0
    assert {r["retention_pct"] for r in activity.day_n_retention(bits).collect()} == {0.0}


def test_no_user_enters_a_shuffle(spark):
    """The written rows are scanned and counted; what is shuffled is keyed by calendar values only."""
    from tallyspark.plans.mart import mart

    bits = mart(spark, SMALL).activity
    for frame in (activity.cohort_activity(bits), activity.week_pairs(bits), activity.day_n_retention(bits)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert exchanges and not any("user_id" in line for line in exchanges)
        assert "Window" not in plan and "SortAggregate" not in plan
