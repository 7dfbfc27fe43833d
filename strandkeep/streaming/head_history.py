"""Head history over a stream of head moves: each machine's open head is state, a move closes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "machine_id long, head long, set_utc timestamp, superseded_utc timestamp"
STATE = "head long, set_us long"


def _closed(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["moved_utc", "seq"])
    head, since = state.get if state.exists else (None, None)
    out = []
    for to, at in zip(rows["head"], rows["moved_utc"], strict=True):
        if head == to:
            continue
        if head is not None:
            out.append((key[0], head, pd.Timestamp(since, unit="us"), at))
        head, since = to, int(at.value // 1000)
    state.update((int(head), since))
    yield pd.DataFrame(out, columns=["machine_id", "head", "set_utc", "superseded_utc"])


def closed_heads(moves: DataFrame) -> DataFrame:
    """The closed rows of the history of streamed moves (machine_id, head, moved_utc, seq), as they close.

    Moves of one trigger are taken in time order; a move to the open head changes nothing. State is one row a
    machine. Later triggers must not bring earlier moves.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return moves.groupBy("machine_id").applyInPandasWithState(_closed, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
