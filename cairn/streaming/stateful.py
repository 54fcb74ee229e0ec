"""Streaming forms of delta delivery and session folding: ordered logs, keyed by client or session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fresh_only(requests: DataFrame) -> DataFrame:
    """(client, seq, hash, reset) -> rows whose hash the client has not been sent since its last reset."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.reset:
                known.clear()
            elif r.hash not in known:
                known.add(r.hash)
                out.append((key[0], r.seq, r.hash))
        state.update((sorted(known),))
        yield pd.DataFrame(out, columns=["client", "seq", "hash"])

    return requests.groupBy("client").applyInPandasWithState(step, "client string, seq long, hash string", "known array<string>", "append", GroupStateTimeout.NoTimeout)


def folded(events: DataFrame) -> DataFrame:
    """(session, seq, kind, payload) -> the session's state after each micro-batch: (session, snapshot, n_completed)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        snapshot, done = state.get if state.exists else (None, 0)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.kind == "snapshot":
                snapshot = r.payload
            elif r.kind in ("reset", "completed"):
                snapshot, done = None, done + (r.kind == "completed")
        state.update((snapshot, done))
        yield pd.DataFrame({"session": [key[0]], "snapshot": [snapshot], "n_completed": [done]})

    return events.groupBy("session").applyInPandasWithState(step, "session string, snapshot string, n_completed long", "snapshot string, n_completed long", "update", GroupStateTimeout.NoTimeout)
