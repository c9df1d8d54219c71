"""Watching trees and scanning blobs incrementally, by Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.files import snapshot_diff
from ..operators.secret_rules import RULES, scan_rules

STATE = "size long, mtime long, seen long"
CHANGES = "repo string, path string, change string, tick long"


def _step(key, batches, state):
    """Compares a path's observations, in order of tick, with the last one."""
    known = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values("tick")
    for r in rows.itertuples():
        now = None if r.gone else (int(r.size), int(r.mtime))
        was = None if known is None or known[2] < 0 else (known[0], known[1])
        if now != was:
            kind = "removed" if now is None else "added" if was is None else "changed"
            yield pd.DataFrame({"repo": [key[0]], "path": [key[1]], "change": [kind], "tick": [int(r.tick)]})
        known = (-1, -1, -1) if now is None else (*now, int(r.tick))
        state.update(known)


def changes(observations: DataFrame) -> DataFrame:
    """Added, changed and removed paths of a stream of observations.

    An observation is repo, path, size, mtime, gone (boolean) and tick (number of the poll);
    a file stream can't show a deletion, so the poller sends it as ``gone``.
    """
    return observations.groupBy("repo", "path").applyInPandasWithState(_step, CHANGES, STATE, "append", "NoTimeout")


def watch(observations: DataFrame, checkpoint: str, act: Callable[[DataFrame], None], errors: list | None = None):
    """Runs ``act`` on every batch of changes; a failing action is noted and watching goes on."""
    def run(batch: DataFrame, _: int) -> None:
        try:
            act(batch)
        except Exception as error:  # the watch outlives its action
            if errors is not None:
                errors.append(f"{type(error).__name__}: {error}")

    return changes(observations).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def poll(snapshot: Callable[[], DataFrame], act: Callable[[DataFrame | None], None], folder: str, polls: int, seconds: float = 2.0,
         errors: list | None = None, rest: Callable[[float], None] = time.sleep) -> int:
    """Acts once at the start (on None), then on the changes between each two snapshots (repo, path, size, mtime), if there are any.

    Snapshots are written below ``folder``, which executors share; a failing action is noted and
    polling goes on.  Returns how often it acted.
    """
    def do(found: DataFrame | None) -> int:
        try:
            act(found)
        except Exception as error:  # the watch outlives its action
            if errors is not None:
                errors.append(f"{type(error).__name__}: {error}")
        return 1

    def keep(k: int) -> DataFrame:
        df = snapshot().select("repo", "path", "size", "mtime")
        df.write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{k % 2}")

    acted, last = do(None), keep(0)
    for k in range(1, polls + 1):
        rest(seconds)
        now = keep(k)
        found = snapshot_diff(last, now)
        acted += 0 if found.isEmpty() else do(found)
        last = now
    return acted


def scan_new(blobs: DataFrame, checkpoint: str, out: str, rules=RULES):
    """Scans blobs that came since the last run; the checkpoint remembers which."""
    found = scan_rules(blobs, rules)
    return found.writeStream.option("checkpointLocation", checkpoint).format("parquet").option("path", out).trigger(availableNow=True).start()


def activity_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with a watermark; the same on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
