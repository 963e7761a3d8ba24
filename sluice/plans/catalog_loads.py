"""Registered queries of keyed loads and equal-depth ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.numbering import equal_ranges
from ..session import scratch_path
from ..sinks.commit import fan_out, prepare, read_committed
from ..sinks.indexed import lookup, write_indexed
from ..sinks.keyed import append_keyed
from ..streaming.logs import follow_logs, running_summary
from . import ledger
from .catalog import register, table
from .catalog_more import _HOT_SQL, _LEDGER_NOW, _event_ledger, _now, event_log_lines, hot_lineitem


@register(
    "key_auto_increment",
    """WITH even AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id, l_orderkey, l_linenumber
                     FROM lineitem WHERE l_orderkey % 2 = 0),
       odd AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) + (SELECT count(*) FROM even) AS id,
                      l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 <> 0)
       SELECT * FROM even UNION ALL SELECT * FROM odd""",
)
def key_auto_increment(spark, sf_dir):
    # two loads of one target: the second one's numbers go on from the first one's largest
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    path = scratch_path(spark)
    append_keyed(rows.filter("l_orderkey % 2 = 0"), path, "id", ["l_orderkey", "l_linenumber"])
    append_keyed(rows.filter("l_orderkey % 2 <> 0"), path, "id", ["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path).select("id", "l_orderkey", "l_linenumber")


def _ntile_sql(value: str, source: str, k: int) -> str:
    return (f"SELECT tile, min(v) AS low, max(v) AS high, count(*) AS rows FROM (SELECT {value} AS v, "
            f"ntile({k}) OVER (ORDER BY {value}) AS tile FROM {source}) GROUP BY tile")


register("split_ranges", _ntile_sql("o_totalprice", "orders WHERE o_totalprice IS NOT NULL", 64))(
    lambda spark, d: equal_ranges(table(spark, d, "orders"), "o_totalprice", 64))

register("split_ranges_hot", _ntile_sql(f"({_HOT_SQL})", f"lineitem WHERE ({_HOT_SQL}) IS NOT NULL", 100))(
    lambda spark, d: equal_ranges(hot_lineitem(spark, d), "price", 100))

register("split_ranges_text", _ntile_sql("c_name", "customer WHERE c_name IS NOT NULL", 16))(
    lambda spark, d: equal_ranges(table(spark, d, "customer").select(F.col("c_name")), "c_name", 16))


@register(
    "ledger_compacted",
    f"""SELECT 'job-' || user_id AS job_id, sha256(CAST(user_id AS VARCHAR)) AS request_hash, arg_max(event_type, ts) AS state
        FROM events WHERE ts >= TIMESTAMP '{_LEDGER_NOW}' - INTERVAL 240 HOUR GROUP BY user_id""",
)
def ledger_compacted(spark, sf_dir):
    # half of the entries are in the snapshot, the others come after it
    path = _event_ledger(spark, sf_dir)
    late = spark.read.parquet(path).filter("pmod(hash(job_id, ts), 2) = 0")
    early = scratch_path(spark)
    spark.read.parquet(path).filter("pmod(hash(job_id, ts), 2) = 1").write.partitionBy(ledger.DAY).parquet(early)
    ledger.compact(spark, early)
    late.write.mode("append").partitionBy(ledger.DAY).parquet(early)
    return ledger.latest_states(spark, early, ttl_hours=240, now=_now()).select("job_id", "request_hash", "state")


@register(
    "log_summary_stream",
    """SELECT 'user-' || user_id AS job_id, count(*) AS total_events,
              count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings
       FROM events GROUP BY user_id""",
)
def log_summary_stream(spark, sf_dir):
    # the lines arrive in two lots; the second run is another query that goes on from the checkpoint
    logs, out, checkpoint = (scratch_path(spark) for _ in range(3))
    for lot in (0, 1):
        lines = event_log_lines(spark, sf_dir).filter(F.pmod(F.xxhash64("value"), F.lit(2)) == lot)
        lines.write.mode("append").text(logs)
        follow_logs(spark, logs, out, checkpoint)
    return running_summary(spark, out)


@register(
    "fan_out_committed",
    """SELECT 'open' AS destination, o_orderkey FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'other', o_orderkey FROM orders WHERE o_orderstatus <> 'O'""",
)
def fan_out_committed(spark, sf_dir):
    orders, root = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), scratch_path(spark)
    frames = {"open": orders.filter("o_orderstatus = 'O'"), "other": orders.filter("o_orderstatus <> 'O'")}
    prepare(frames["open"], root, "open", "broken")  # a load that never got to its commit
    fan_out(spark, frames, root)
    both = [read_committed(spark, root, name).select(F.lit(name).alias("destination"), "o_orderkey") for name in frames]
    return both[0].unionByName(both[1])


@register("indexed_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (7, 77, 149, 1000003)")
def indexed_lookup(spark, sf_dir):
    path = scratch_path(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_indexed(orders, path, "o_orderkey", ["o_custkey"], files=24)
    return lookup(spark, path, ["o_orderkey", "o_custkey"], "o_custkey", [7, 77, 149, 1000003])
