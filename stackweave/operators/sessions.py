"""Reading sessions: what was read last, and where to go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENCY = ("last_opened_at", "started_at", "session_id")
# State changes of a session by action.
MOVES = {"resume": {"paused": "active", "active": "active"}, "pause": {"active": "paused", "paused": "paused"}, "end": {"active": "closed", "paused": "closed"}}


def _latest_first() -> list:
    return [F.desc(c) for c in RECENCY]


def recent(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions, the latest first; with a limit a top-k without a shuffle."""
    rows = sessions.orderBy(*_latest_first())
    return rows if limit is None else rows.limit(limit)


def latest(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """The latest session of each key: a grouped maximum, combined before its shuffle."""
    order = F.struct(*RECENCY)
    return sessions.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in sessions.columns if c not in keys]), order).alias("s")).select(*keys, "s.*")


def continue_target(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Where each key goes on: its latest session that is not closed, else its latest."""
    order = F.struct((F.col("state") != "closed").cast("int").alias("open"), *RECENCY)
    return sessions.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in sessions.columns if c not in keys]), order).alias("s")).select(*keys, "s.*")


def with_asset_status(sessions: DataFrame, assets: DataFrame) -> DataFrame:
    """Sessions with their asset's status; ``invalid`` where the asset is unknown."""
    return sessions.join(assets.select("asset_id", "status"), "asset_id", "left").withColumn("status", F.coalesce("status", F.lit("invalid")))


def apply_action(state: str, action: str) -> str:
    """A session's next state; a closed session takes no action."""
    if state not in MOVES.get(action, {}):
        raise ValueError(f"cannot {action} a session that is {state}")
    return MOVES[action][state]


def numbered(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions of each key with their number, 1 for the latest."""
    return sessions.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_latest_first())))
