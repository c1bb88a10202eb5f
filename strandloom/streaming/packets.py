"""Packets that arrive in pieces, late and more than once: each is closed once, with the numbers and counts that a batch over its rows gives.

A packet's state is the keys of its rows, without sequences. Rows that were met before change nothing. A packet closes when the
watermark passes the latest time of its rows: its rows are numbered and its transcripts counted as in a batch, and from then on its state
is a mark that it is closed, so a packet that is sent again is dropped whenever it comes. State is in the checkpoint: a restart goes on with the same numbers.

Edge cases: rows that are later than the watermark allows are dropped, as a batch over the rows in time would not have them; rows
without a sample, a packet, an ordinal or a time take no part; a packet without rows never opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.runtime import ship

KEYS = ["sample_id", "packet_id"]
STATE = "closed boolean, latest long, ordinals array<long>, row_keys array<string>, transcripts array<string>"

Finish = Callable[[pd.DataFrame], pd.DataFrame]


def closing(molecules: DataFrame, finish: Finish, schema: str, time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """A row table for each packet, once, when it closes: finish gets its rows (ordinal, row_key, transcript_id) in their order, and returns columns of schema besides the packet's."""
    ship(molecules.sparkSession)
    rows = molecules.select(*KEYS, "ordinal", "row_key", "transcript_id", F.col(time).cast("timestamp").alias("_time"))
    rows = rows.filter(F.col("sample_id").isNotNull() & F.col("packet_id").isNotNull() & F.col("ordinal").isNotNull() & F.col("_time").isNotNull()).withWatermark("_time", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, latest, ordinals, names, transcripts = state.get if state.exists else (False, 0, [], [], [])
        if state.hasTimedOut:
            order = pd.DataFrame({"ordinal": list(ordinals), "row_key": list(names), "transcript_id": list(transcripts)}).sort_values(["ordinal", "row_key"], kind="stable", ignore_index=True)
            state.update((True, latest, [], [], []))
            out = finish(order)
            out.insert(0, "packet_id", key[1])
            out.insert(0, "sample_id", key[0])
            yield out
            return
        if closed:
            return
        ordinals, names, transcripts = list(ordinals), list(names), list(transcripts)
        met = set(zip(ordinals, names, strict=True))
        for pdf in batches:
            for ordinal, name, transcript, at in zip(pdf["ordinal"].tolist(), pdf["row_key"], pdf["transcript_id"], pdf["_time"], strict=True):
                latest = max(latest, int(at.timestamp() * 1000))
                if (ordinal, name) not in met:
                    met.add((ordinal, name))
                    ordinals.append(ordinal)
                    names.append(name)
                    transcripts.append(transcript)
        state.update((False, latest, ordinals, names, transcripts))
        # the time of a timeout must lie beyond the watermark
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy(*KEYS).applyInPandasWithState(step, f"sample_id string, packet_id int, {schema}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def numbered(molecules: DataFrame, lanes: tuple[int, ...], time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """sample_id, packet_id, row_key, cluster_id and lane of each row of a packet that closes: what flowcell.assign_lanes gives for the whole packet."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        n, k = len(rows), len(lanes)
        place = rows.index + 1
        at = place % k if n < k else (place // max(1, n // k)).map(lambda x: min(k - 1, x))
        return pd.DataFrame({"row_key": rows["row_key"], "cluster_id": place, "lane": [lanes[i] for i in at]})

    return closing(molecules, finish, "row_key string, cluster_id long, lane int", time, delay)


def quantified(molecules: DataFrame, time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """sample_id, packet_id, transcript_id and counts of each packet that closes: what analytics.quantify gives."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows.groupby("transcript_id", dropna=False, sort=True).size()
        return pd.DataFrame({"transcript_id": [None if pd.isna(x) else x for x in counts.index], "counts": counts.to_numpy()})

    return closing(molecules, finish, "transcript_id string, counts long", time, delay)


def write(closed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what closes to Parquet, over all that has arrived; the next call goes on from there."""
    return closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
