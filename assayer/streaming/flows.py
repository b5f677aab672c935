"""Incremental forms of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.agreement import micros
from assayer.operators.gates import violations
from assayer.operators.grids import thinned


def thin_stream(events: DataFrame, key: str, ratio: float) -> DataFrame:
    """Stateless: the same events stay as in a batch run."""
    return thinned(events, key, ratio)


def submission_stream(arriving: DataFrame, key: str, rules: dict[str, str], board: str, failed: str, checkpoint: str):
    """Each batch is gated; what breaks a rule goes to ``failed`` with the rule, the rest is appended to ``board``.

    Both writes carry the batch number, so that a repeated batch replaces its own folder and nothing is doubled.
    """

    def gate(batch: DataFrame, number: int) -> None:
        broken = violations(batch, key, rules)
        batch.join(broken.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(f"{board}/batch={number}")
        batch.join(broken, key).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return arriving.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint)


def drift_stream(cases: DataFrame, reader: str, agrees: str, window: int = 50, least: float = 0.6) -> DataFrame:
    """Per reader, the share of agreement of every full window of cases and whether it pauses the reader.

    State: cases and agreements of the open window.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, good = state.get if state.exists else (0, 0, 0)
        out = []
        for frame in frames:
            for ok in frame[agrees]:
                n, good = n + 1, good + int(bool(ok))
                if n == window:
                    out.append((key[0], number, good / n, good / n < least))
                    number, n, good = number + 1, 0, 0
        state.update((number, n, good))
        yield pd.DataFrame(out, columns=[reader, "window", "share", "paused"])

    schema = f"{reader} string, window long, share double, paused boolean"
    return cases.select(reader, F.col(agrees)).groupBy(reader).applyInPandasWithState(step, schema, "number long, n long, good long", "append", GroupStateTimeout.NoTimeout)


#: Windows whose kappas are worked out at once.
_WINDOWS = 512


def _kappas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unweighted kappa of every row of two matrices; 1 where chance leaves nothing to disagree on."""
    n = a.shape[1]
    # as many pairs of equal answers as the products of both sides' counts
    chance = n * n - (a[:, :, None] == b[:, None, :]).sum((1, 2))
    return np.where(chance == 0, 1.0, 1 - (a != b).sum(1) * n / np.maximum(chance, 1))


def kappa_drift_stream(cases: DataFrame, reader: str, time: str, key: str, a: str, b: str, delay: str, window: int = 50, least: float = 0.6) -> DataFrame:
    """(reader, window, n, kappa, paused) of every full window of a reader's cases in order of ``time``, then ``key``, as the batch form has them.

    Cases wait until the watermark has passed their time, so the order in which they arrive within ``delay`` makes no difference; later ones
    are dropped. State: the cases that wait, as many as arrive in ``delay``, and the open window, each column as the bytes of its numbers.
    ``a`` and ``b`` are whole numbers; a case without a key comes before others of its time.
    """
    known = cases.where(F.col(time).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    known = known.withColumn("_time", F.timestamp_micros(micros(cases, time))).withWatermark("_time", delay)
    known = known.select(reader, "_time", F.unix_micros("_time").alias("at"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n_open, *columns = state.get if state.exists else (0, 0, b"", b"", b"", b"")
        held = np.stack([np.frombuffer(bytes(c), np.int64) for c in columns])
        new = [held[:, n_open:], *(np.stack([frame[c].to_numpy(np.int64) for c in ("at", "id", "a", "b")]) for frame in frames)]
        waiting = np.concatenate(new, axis=1)
        waiting = waiting[:, np.lexsort(waiting[::-1])]
        passed = state.getCurrentWatermarkMs()
        ripe = int(np.searchsorted(waiting[0] // 1000, passed, side="right"))
        opened, waiting = np.concatenate([held[:, :n_open], waiting[:, :ripe]], axis=1), waiting[:, ripe:]
        full, out = opened.shape[1] // window, []
        for at in range(0, full, _WINDOWS):
            upto = min(at + _WINDOWS, full)
            k = _kappas(*(opened[c, at * window : upto * window].reshape(-1, window) for c in (2, 3)))
            out.append(pd.DataFrame({reader: [group[0]] * len(k), "window": np.arange(number + at, number + upto), "n": window, "kappa": k, "paused": k < least}))
        opened = opened[:, full * window :]
        both = np.concatenate([opened, waiting], axis=1)
        state.update((number + full, opened.shape[1], *(row.tobytes() for row in both)))
        if waiting.shape[1]:
            state.setTimeoutTimestamp(max(int(waiting[0, 0]) // 1000, passed) + 1)
        yield from out or [pd.DataFrame([], columns=[reader, "window", "n", "kappa", "paused"])]

    schema = f"{reader} {dict(cases.dtypes)[reader]}, window long, n long, kappa double, paused boolean"
    held = "number long, n_open long, " + ", ".join(f"{c} binary" for c in ("at", "id", "a", "b"))
    return known.groupBy(reader).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
