"""Streaming queries, run to the end over what is there; their oracle is the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...streaming import windows as st
from ..catalog import register


@register("stream_tumbling", "select time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    e = st.read_events(spark, f"{sf_dir}/events.parquet")
    out = st.run_available(st.tumbling(e, "6 hours", "1 hour", ("event_type",), "value"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("event_type").alias("kind"), "n", F.round("total", 4).alias("total"))


@register("stream_sliding", "select s as start, count(*) as n, round(sum(value), 4) as total from (select unnest([time_bucket(interval '12 hours', ts, timestamp '2000-01-01'), time_bucket(interval '12 hours', ts, timestamp '2000-01-01') - interval '12 hours']) s, value from events) group by 1")
def stream_sliding(spark, sf_dir):
    """Windows of a day that start every twelve hours."""
    e = st.read_events(spark, f"{sf_dir}/events.parquet")
    out = st.run_available(st.sliding(e, "24 hours", "12 hours", "1 hour", (), "value"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@register("stream_session", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '4 hours' then 0 else 1 end s from events), r as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id as key, min(ts) as start, count(*) as n from r group by user_id, k")
def stream_session(spark, sf_dir):
    e = st.read_events(spark, f"{sf_dir}/events.parquet")
    out = st.run_available(st.sessions(e, "4 hours", "1 hour", "user_id"), "complete")
    return out.select(F.col("user_id").alias("key"), F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_dedup", "select event_id, user_id, event_type from events")
def stream_dedup(spark, sf_dir):
    """The events twice, each kept once."""
    e = st.read_events(spark, f"{sf_dir}/events.parquet")
    twice = e.withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    return st.run_available(st.deduplicated(twice, ["event_id"], "1 hour").select("event_id", "user_id", "event_type"))


@register("stream_replay", "with s as (select user_id traj, row_number() over (partition by user_id order by ts, event_id) step, cast(json_extract_string(props, '$.k') as bigint) k, event_id from events) select traj, k % 10 as item, arg_max(k, event_id) as owner, max(event_id) as step from s group by 1, 2")
def stream_replay(spark, sf_dir):
    """Stateful replay: the last emitted owner of each item."""
    e = st.read_events(spark, f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    out = st.run_available(st.replay(e.select(F.col("user_id").alias("traj"), (k % 10).alias("item"), k.alias("owner"), F.col("event_id").alias("step"))))
    return out.groupBy("traj", "item").agg(F.max_by("owner", "step").alias("owner"), F.max("step").alias("step"))
