"""New event files into written tables, without reading the old ones in full again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import clean, tables
from tallyspark.plans.shared import replace_with, write_by, written
from tallyspark.sources.schema import RAW_EVENTS
from tallyspark.sources.store import read_events_parquet, read_tables_parquet, write_tables_parquet


def _merged_events(old: DataFrame, fresh: DataFrame, months: list[str]) -> DataFrame:
    """Old and new events of the given months. The key of an event holds its time, so copies are of the
    same month and a copy kept before meets the new one here, whichever file brought either."""
    kept = old.filter(F.col("event_month").isin(months))  # prunes directories
    both = kept.select(*RAW_EVENTS.names).unionByName(fresh.select(*RAW_EVENTS.names))
    return clean.derived_columns(both.transform(clean.dedup_by_month))


#: New keys that are broadcast, some 32 MB of them; more take a shuffle join.
BROADCAST_KEYS = 1_000_000


def _sized(keys: DataFrame) -> DataFrame:
    """Keys, broadcast if they are few. Left to the planner, a join to keys of unknown number shuffles all
    events before their number is known."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _keys(fresh: DataFrame, key: str) -> DataFrame:
    """The users, products or sessions of the new events."""
    return _sized(fresh.select(key).distinct())


def _users(old: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    """Users of the new events from all their events; of the others only what is relative to the
    latest event changes, and that follows from their rows."""
    latest = (
        old.agg(F.max("last_seen").alias("at")).unionByName(fresh.agg(F.max("event_time").alias("at")))
        .agg(F.max("at")).scalar()
    )
    seen = _keys(fresh, "user_id")
    anew = tables.user_metrics(events.join(seen, "user_id", "left_semi"), latest)
    return tables.with_recency(old.join(seen, "user_id", "left_anti"), latest).unionByName(anew)


def _sessions(old: DataFrame, events: DataFrame, fresh: DataFrame, months: list[str]) -> DataFrame:
    """Sessions of the new events. Only those that reach out of the months are looked for in the events
    of other months; they are few, but the session of all session-less events is usually one."""
    seen = _keys(fresh, "user_session")
    touched = old.join(seen, "user_session", "left_semi")
    inside = [F.date_format(c, "yyyy-MM").isin(months) for c in ("session_start", "session_end")]
    wide = _sized(touched.filter(~(inside[0] & inside[1])).select("user_session"))
    near = events.filter(F.col("event_month").isin(months)).join(seen, "user_session", "left_semi")
    anew = [
        tables.session_metrics(near.join(wide, "user_session", "left_anti")),
        tables.session_metrics(events.join(wide, "user_session", "left_semi")),
    ]
    return old.join(seen, "user_session", "left_anti").unionByName(anew[0]).unionByName(anew[1])


def _products(old: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    seen = _keys(fresh, "product_id")
    anew = tables.product_metrics(events.join(seen, "product_id", "left_semi"))
    return old.join(seen, "product_id", "left_anti").unionByName(anew)


def _days(old: DataFrame, events: DataFrame, months: list[str]) -> DataFrame:
    rest = old.filter(~F.date_format("activity_date", "yyyy-MM").isin(months))
    anew = tables.daily_activity(events.filter(F.col("event_month").isin(months)))
    return rest.unionByName(anew).orderBy("activity_date")


def etl_append(raw: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Append raw events to the five tables that `etl_run` wrote to a folder; the result is that of one
    run over old and new events together. Returns the tables as read back.

    The months that the new events touch are replaced (a file may reach over a month's edge, come
    late or repeat events), other months' files stay. Users, sessions and products of the new events
    are derived anew and joined to the rows of the others. Users and products need their old events,
    so these are scanned, by the columns wanted, but only what belongs to them is aggregated. The keys of the new
    events are broadcast below the session's limit and a shuffle join beyond it, where adaptive
    execution splits a hot key's events.

    A repeated call changes nothing, so one that broke off is called again; if it broke off
    while a derived table was replaced, `store.derive_tables` first makes these from the events.
    Times and keys are those of cleaned events; nothing is written for a feed without any.
    """
    spark = raw.sparkSession
    fresh = written(clean.clean_events(raw, to_write=True), "append-fresh", by="event_month", laid_out=True)
    months = sorted(r[0] for r in fresh.select("event_month").distinct().collect())
    old = read_tables_parquet(spark, folder)
    if not months:
        return old
    merged = _merged_events(old["fact_events"], fresh, months)
    write_by(merged, "event_month", f"{folder}/fact_events.parquet", touched_only=True, laid_out=True)
    events = read_events_parquet(spark, folder)
    anew = {
        "user_metrics": _users(old["user_metrics"], events, fresh),
        "session_metrics": _sessions(old["session_metrics"], events, fresh, months),
        "product_metrics": _products(old["product_metrics"], events, fresh),
        "daily_activity": _days(old["daily_activity"], events, months),
    }
    # A table can't be replaced while it is read: the new ones are written once, beside the old ones.
    beside = f"{folder}/_next"
    write_tables_parquet(anew, beside)
    replace_with(spark, {f"{folder}/{name}.parquet": f"{beside}/{name}.parquet" for name in anew})
    return read_tables_parquet(spark, folder)
