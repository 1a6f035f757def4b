"""What documents have told so far, kept over a stream of mentions; and mentions of streamed documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.coref import mentions

OUTPUT = "doc_id long, name_lc string, name string, type string, chunk_id int, offset long"


def stream_mentions(docs: DataFrame) -> DataFrame:
    """mentions() of a streaming DataFrame; it has no state."""
    return mentions(docs)


def mention_rates(found: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, pronoun_type, n): mentions in tumbling windows of event time; rows later than `late` are dropped, and with them old state."""
    return found.withWatermark(time, late).groupBy(F.window(time, window), "pronoun_type").agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Of a stream (doc_id, chunk_id, offset, name, type), each document's entities when they are first seen.

    The state of a document is the names it has given; it goes when no mention has come for `idle`.
    Within a micro-batch the smallest (chunk_id, offset, name) is first. Rows without a name are left out.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = set(json.loads(state.get[0])) if state.exists else set()
        b = pd.concat(list(frames)).dropna(subset=["name"])
        b = b.assign(name_lc=b["name"].str.lower()).sort_values(["chunk_id", "offset", "name"]).drop_duplicates("name_lc")
        b = b[~b["name_lc"].isin(known)]
        state.update((json.dumps(sorted(known | set(b["name_lc"]))),))
        state.setTimeoutDuration(millis)
        yield b[["doc_id", "name_lc", "name", "type", "chunk_id", "offset"]]

    return rows.groupBy("doc_id").applyInPandasWithState(step, OUTPUT, "names string", "append", GroupStateTimeout.ProcessingTimeTimeout)
