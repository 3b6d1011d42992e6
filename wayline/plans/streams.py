"""The stream operators on a table."""

from pyspark.sql import functions as F

from wayline.plans.registry import query, table
from wayline.streaming.events import windowed_counts


@query("event_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    out = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value", "1 day", "2 hours")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
