"""Source-side queries: payload drill and landed-page round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.payloads import drill
from .catalog import register, table

# Records per landed page.  Pages are cut from consecutive row ids inside
# one task, so no page can hold more than this many records.
PAGE_RECORDS = 100


def event_pages(spark, sf_dir):
    """The events table landed as JSON pages ``{"data": {"items": [...]}}``."""
    ev = table(spark, sf_dir, "events")
    rec = F.struct("event_id", "user_id", "event_type", "value")
    paged = ev.select(F.floor(F.monotonically_increasing_id() / PAGE_RECORDS).alias("page"), rec.alias("rec"))
    pages = paged.groupBy("page").agg(F.collect_list("rec").alias("items"))
    return pages.select("page", F.to_json(F.struct(F.struct("items").alias("data"))).alias("body"))


def prop_pages(spark, sf_dir):
    """The events' properties as JSON pages of one record each, text and numbers as they are."""
    props = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"items": [{"event_id": '), F.col("event_id"), F.lit(', "k": '), props, F.lit(', "code": "00'),
                    props, F.lit('"}]}'))
    return table(spark, sf_dir, "events").select(body.alias("body"))


register("records_drill", "SELECT event_id, user_id, event_type, value FROM events")(
    lambda spark, d: drill(event_pages(spark, d), "body", "data.items")
)

register(
    "records_drill_props",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
              '00' || CAST(json_extract(props, '$.k') AS BIGINT) AS code FROM events""",
)(
    lambda spark, d: drill(prop_pages(spark, d), "body", "items")
)
