"""The run lifecycle on streams: keyed states for progress, admission and silence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "failed", "cancelled")


def job_states(progress: DataFrame) -> DataFrame:
    """A stream of (job, seq, kind, stage, percent, now_ms) to the state after each batch: percent never falls, the end is final.

    kind is update, completed, failed or cancelled; a run that has ended is in the stage of that name.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, stage, percent, started = state.get if state.exists else ("queued", "queued", 0, -1)
        for rows in frames:
            for r in rows.sort_values(["now_ms", "seq"]).itertuples():
                if status in TERMINAL:
                    break
                if r.kind in TERMINAL:
                    status, stage, percent, started = r.kind, r.kind, 100 if r.kind == "completed" else percent, int(r.now_ms)
                    continue
                status = "running"
                if r.stage != stage:
                    stage, started = r.stage, int(r.now_ms)
                percent = min(99, max(percent, int(r.percent)))
        state.update((status, stage, percent, started))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "stage": [stage], "percent": [percent], "stage_started": [started]})

    out = "job long, status string, stage string, percent int, stage_started long"
    return progress.groupBy("job").applyInPandasWithState(step, out, "status string, stage string, percent int, started long", "update", GroupStateTimeout.NoTimeout)


def admit_stream(attempts: DataFrame, window_ms: int, most: int) -> DataFrame:
    """A stream of (client, seq, now_ms) to decisions: windows open with a client's first attempt and admit most of them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-(1 << 60), 0)
        for rows in frames:
            out: list[dict[str, Any]] = []
            for r in rows.sort_values(["now_ms", "seq"]).itertuples():
                if r.now_ms - start >= window_ms:
                    start, used = int(r.now_ms), 0
                ok = used < most
                used += ok
                out.append({"client": key[0], "seq": r.seq, "now_ms": r.now_ms, "admitted": ok})
            yield pd.DataFrame(out, columns=["client", "seq", "now_ms", "admitted"])
        state.update((start, used))

    return attempts.groupBy("client").applyInPandasWithState(step, "client long, seq long, now_ms long, admitted boolean", "start long, used int", "append", GroupStateTimeout.NoTimeout)


def silence_alarms(progress: DataFrame, silence_ms: int) -> DataFrame:
    """A stream of (job, seq, kind) to alarms of jobs without a report for silence_ms of processing time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "alarm": ["silent"]})
            return
        over = any(rows["kind"].isin(TERMINAL).any() for rows in frames)
        if over:
            if state.exists:
                state.remove()
            return
        state.update((1,))
        state.setTimeoutDuration(silence_ms)

    return progress.groupBy("job").applyInPandasWithState(step, "job long, alarm string", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)
