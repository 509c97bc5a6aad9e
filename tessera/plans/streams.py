"""Registered queries of the event operators (STR); the same functions run over
``readStream``, see the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import table
from ..streaming import events as E
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()


@query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def tumbling_rate_limit(spark, d):
    """STR-1, STR-2."""
    return E.over_limit(table(spark, d, "events", ["user_id", "ts"]), "ts", ["user_id"], 3600, 1)


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 0")
def daily_counts(spark, d):
    """STR-2."""
    return E.over_limit(table(spark, d, "events", ["event_type", "ts"]), "ts", ["event_type"], 86400, 0)


@query("SELECT max(ts) < TIMESTAMP '2100-01-01' - INTERVAL 30 DAY AS stale FROM events")
def staleness(spark, d):
    """STR-11."""
    return E.stale(table(spark, d, "events", ["ts"]), "ts", F.lit("2100-01-01").cast("timestamp_ntz"), 30)


@query("SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 = 1) GROUP BY 1")
def resumable_batch(spark, d):
    """STR-4, STR-5, STR-8: staged: pick, skip what is done, count."""
    from ..operators.joins import not_yet

    rows = table(spark, d, "events", ["event_id", "user_id"])
    stages = {
        "pick": lambda x: x.where("event_id % 2 = 0"),
        "skip": lambda x: not_yet(x, rows.where("event_id % 10 = 1"), ["user_id"]),
        "count": lambda x: x.groupBy("user_id").agg(F.count("*").alias("n")),
    }
    return E.run_stages(stages, rows)
