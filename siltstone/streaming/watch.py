"""A watcher as a stream: changes per path, and bursts of changes gathered by session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def path_changes(snapshots: DataFrame) -> DataFrame:
    """(path, ts, action) from a stream of (path, ts, digest): added, modified or deleted by the last digest of a path.

    A null digest says that the path is gone. A digest that repeats changes nothing. State is one digest a path.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            now = None if pd.isna(row.digest) else row.digest
            if now != last:
                rows.append((key[0], row.ts, "added" if last is None else "deleted" if now is None else "modified"))
            last = now
        state.update((last,))
        yield pd.DataFrame(rows, columns=["path", "ts", "action"])

    return snapshots.groupBy("path").applyInPandasWithState(
        step, "path string, ts timestamp, action string", "digest string", "append", "NoTimeout"
    )


def bursts(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(start, end, changes, paths): changes of one root that come within `quiet` of each other, as one event."""
    gathered = changes.withWatermark("ts", late).groupBy(F.session_window("ts", quiet).alias("w"), "root")
    return gathered.agg(F.count("*").alias("changes"), F.approx_count_distinct("path").alias("paths")).select("root", "w.start", "w.end", "changes", "paths")
