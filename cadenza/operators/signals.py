"""Listening signals of users, from the events table: likes, plays and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

#: Which group an event counts to.
GROUPS = {"signup": "manual", "purchase": "liked", "click": "recent", "view": "short_term", "error": "long_term"}


def _track() -> Column:
    return (F.get_json_object("props", "$.k").cast("long") + 1).alias("track_id")


def likes(c: Catalog) -> DataFrame:
    """(user_id, track_id, liked_at): the latest like of each track."""
    liked = c.raw("events").where(F.col("event_type") == "purchase").select("user_id", _track(), "ts")
    return liked.groupBy("user_id", "track_id").agg(F.max("ts").alias("liked_at"))


def signals(c: Catalog) -> DataFrame:
    """(user_id, source, track_id, played_at, interaction_count): one row for each user, group and track."""
    group = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])[F.col("event_type")]
    rows = c.raw("events").select("user_id", F.coalesce(group, F.lit("long_term")).alias("source"), _track(), "ts")
    return rows.groupBy("user_id", "source", "track_id").agg(F.max("ts").alias("played_at"), F.count("*").alias("interaction_count"))


SIGNALS_SQL = (
    "signals as (select user_id, case event_type "
    + " ".join(f"when '{k}' then '{v}'" for k, v in GROUPS.items())
    + " else 'long_term' end as source, 1 + cast(json_extract_string(props, '$.k') as bigint) as track_id, max(ts) as played_at, count(*) as interaction_count from events group by 1, 2, 3)"
)
