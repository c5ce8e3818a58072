"""Replay of conditional history operations as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenfold.sources.history import FLAVOURS

OUTCOMES = "thread_id string, seq long, op string, accepted boolean, version long, n_messages long"
_STATE = "version long, messages array<string>"


def _replay(flavour: str):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, messages = state.get if state.exists else (0, [])
        messages = list(messages)
        out = []
        for op in pd.concat(list(frames)).sort_values("seq").itertuples():
            payloads = [] if op.payloads is None else list(op.payloads)
            idle = op.op == "append" and not payloads
            accepted = idle or op.expected_version == version
            if accepted and not idle:
                messages = messages + payloads if op.op == "append" else payloads if op.op == "save" else []
                version = 0 if flavour == "reset" and not messages else version + 1
            out.append((key[0], op.seq, op.op, accepted, version, len(messages)))
        state.update((version, messages))
        yield pd.DataFrame(out, columns=["thread_id", "seq", "op", "accepted", "version", "n_messages"])

    return step


def replay_stream(ops: DataFrame, flavour: str = "monotonic") -> DataFrame:
    """Outcome of each op of a stream (thread_id, seq, op, expected_version, payloads), in append mode.

    A thread's version and messages are the state; ops of one thread must not come out of order
    over batches, and are put in order of ``seq`` within one.
    """
    if flavour not in FLAVOURS:
        raise ValueError(f"unknown flavour {flavour}")
    return ops.groupBy("thread_id").applyInPandasWithState(_replay(flavour), OUTCOMES, _STATE, "append", GroupStateTimeout.NoTimeout)
