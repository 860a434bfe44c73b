"""Queries of the incremental upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import landing
from ..streaming import upsert
from .common import table, tidy

#: Batches of the late-row query: events arrive by the third digit of their id, so each batch spans all days.
DEALT = "(CAST(floor(event_id / 100) AS BIGINT) % 4)"
SQL = {
    "sm01_streaming_upsert": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "sm01_late_rows": f"SELECT event_id, batch FROM (SELECT e.event_id, {DEALT} AS batch, e.ts, (SELECT max(x.ts) FROM events x WHERE (CAST(floor(x.event_id / 100) AS BIGINT) % 4) < (CAST(floor(e.event_id / 100) AS BIGINT) % 4)) AS seen FROM events e) WHERE ts < seen - INTERVAL 10 DAY",
    "sm01_upsert_with_late_rows": f"""WITH b AS (SELECT *, {DEALT} AS batch FROM events), top AS (SELECT batch, max(ts) AS m FROM b GROUP BY batch),
ok AS (SELECT b.* FROM b LEFT JOIN (SELECT t.batch, max(u.m) AS seen FROM top t LEFT JOIN top u ON u.batch < t.batch GROUP BY t.batch) s USING (batch) WHERE seen IS NULL OR ts >= seen - INTERVAL 10 DAY)
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM ok) WHERE r = 1""",
}


def keyed(spark, sf):
    return table(spark, sf, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "user_id", "event_type", "event_id", F.col("ts").cast("string").alias("at"))


def sm01_streaming_upsert(spark, sf):
    """All events land as JSON lines and stream, a few files a batch, into a table of the latest per user and type."""
    base = landing.work_dir(spark)
    keyed(spark, sf).repartition(6, "event_id").write.json(f"{base}/landing")
    upsert.run(spark, f"{base}/landing", "key string, user_id long, event_type string, event_id long, at string", f"{base}/table", f"{base}/progress", "key", "event_id", "at", "3650 days", 3, buckets=16)
    return tidy(upsert.current(spark, f"{base}/table").select("user_id", "event_type", "event_id"))


def dealt(spark, sf):
    """A table of all events in four batches, of which late ones are kept aside."""
    target = f"{landing.work_dir(spark)}/table"
    for i in range(4):
        batch = keyed(spark, sf).where(F.floor(F.col("event_id") / 100) % 4 == i)
        upsert.merge(batch, i, target, "key", "event_id", buckets=16, event_time="at", late="10 days", most=2)
    return target


def sm01_late_rows(spark, sf):
    late = upsert.late_rows(spark, dealt(spark, sf))
    return tidy(late.select("event_id", "batch")) if late is not None else spark.createDataFrame([], "event_id long, batch long")


def sm01_upsert_with_late_rows(spark, sf):
    return tidy(upsert.current(spark, dealt(spark, sf)).select("user_id", "event_type", "event_id"))


QUERIES = {"sm01_streaming_upsert": sm01_streaming_upsert, "sm01_late_rows": sm01_late_rows, "sm01_upsert_with_late_rows": sm01_upsert_with_late_rows}
