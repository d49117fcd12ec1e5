"""Streams: index changes folded batch by batch, and session states kept by key.

Both are extensions of batch operators: a stream's result equals the batch operator's over
the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import MOVES
from ..sources import files


def apply_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``apply(batch, id)`` for each batch of change events.

    A batch that was applied is marked beside the checkpoint and not applied again, also
    after a restart.  One that was cut short between the two is applied again, so ``apply``
    should replace what an earlier try with the same id left.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        mark = f"{checkpoint.rstrip('/')}-applied/{batch_id}.json"
        if not files.exists(batch.sparkSession, mark):
            apply(batch.dropDuplicates(), batch_id)
            files.write_json(batch.sparkSession, mark, {"batch": batch_id})

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


STATE = "state string, last_opened_at timestamp"
OUT = "item_id bigint, asset_id bigint, state string, last_opened_at timestamp, refused int"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    current, last = state.get if state.exists else (None, None)
    refused = 0
    events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for e in events.itertuples():
        if e.action == "start" and current in (None, "closed"):
            current, last = "active", e.ts
        elif current in MOVES.get(e.action, {}):
            current = MOVES[e.action][current]
            last = e.ts if e.action == "resume" else last
        else:
            refused += 1
    state.update((current, last))
    yield pd.DataFrame({"item_id": [key[0]], "asset_id": [key[1]], "state": [current], "last_opened_at": [last], "refused": [refused]})


def session_states(events: DataFrame) -> DataFrame:
    """The state of each (item, asset) after its events (event_id, ts, item_id, asset_id, action); state is kept between batches."""
    return events.groupBy("item_id", "asset_id").applyInPandasWithState(_step, OUT, STATE, "update", "NoTimeout")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out and their windows' state is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count()
