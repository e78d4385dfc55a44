"""Ordered application of numbered events, windowed telemetry and decayed counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Events that may wait for a missing one before the oldest are given up.
AHEAD = 256


def apply_in_order(revision: int, waiting: dict[int, str], events: list[tuple[int, str]], ahead: int = AHEAD):
    """Events numbered revision + 1 are applied, later ones wait, earlier ones are dropped.

    Returns the new revision, what waits, and (seq, payload, outcome) rows.  When more than
    ``ahead`` wait, the lowest numbers are evicted.
    """
    out = []
    for seq, payload in events:
        if seq <= revision or seq in waiting:
            out.append((seq, payload, "dropped"))
            continue
        waiting[seq] = payload
        while revision + 1 in waiting:
            revision += 1
            out.append((revision, waiting.pop(revision), "applied"))
        while len(waiting) > ahead:
            low = min(waiting)
            out.append((low, waiting.pop(low), "evicted"))
    return revision, waiting, out


class OrderedApply(StatefulProcessor):
    """State for each key: the revision, and a map of what waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.revision.get()
        revision = int(found[0]) if found else 0
        waiting = {int(k[0]): v[0] for k, v in self.waiting.iterator()}
        before = set(waiting)
        out = []
        for batch in rows:
            revision, waiting, more = apply_in_order(revision, waiting, list(zip(batch["seq"].tolist(), batch["payload"].tolist(), strict=True)))
            out += more
        self.revision.update((revision,))
        for seq in before - set(waiting):
            self.waiting.removeKey((seq,))
        for seq in set(waiting) - before:
            self.waiting.updateValue((seq,), (waiting[seq],))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "seq", "payload", "outcome"])

    def close(self) -> None:
        pass


OUTPUT = "key string, seq long, payload string, outcome string"


def ordered_stream(events: DataFrame) -> DataFrame:
    """A stream of (key, seq, payload) in order for each key.  Needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=OrderedApply(), outputStructType=OUTPUT, outputMode="append", timeMode="none")


def deduplicated(events: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """First occurrence of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, at: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(keys, start, n, total): tumbling windows; late rows beyond the watermark are dropped."""
    w = events.withWatermark(at, late).groupBy(*keys, F.window(at, size).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(*keys, F.col("w.start").alias("start"), "n", "total")


def session_windows(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def decay(value: float, seconds: float, half_life: float = 30 * 86400.0) -> float:
    return value * 0.5 ** (max(0.0, seconds) / half_life)


def evaporated(emitted: float, cited: float, soft: float = 256, hard: float = 1024) -> tuple[float, float]:
    """Saturated counters shrink with their ratio kept: to the soft bound's root scale beyond
    ``hard``, by half from ``soft`` on."""
    if emitted >= hard:
        scale = (soft / emitted) ** 0.5
        return emitted * scale, cited * scale
    return (emitted / 2, cited / 2) if emitted >= soft else (emitted, cited)


class DecayedCounter(StatefulProcessor):
    """State for each key: a count that halves every ``half_life`` seconds, and its time."""

    def __init__(self, half_life: float = 30 * 86400.0):
        self.half_life = half_life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "value double, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        value, at = found if found else (0.0, None)
        for batch in rows:
            for t in sorted(batch["at"].tolist()):
                if at is None or t >= at:
                    value, at = decay(value, 0 if at is None else t - at, self.half_life) + 1, t
                else:  # late: its share as of the counter's time
                    value += decay(1.0, at - t, self.half_life)
        value = evaporated(value, 0.0)[0]
        self.state.update((value, at))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "at": [at]})

    def close(self) -> None:
        pass


def decayed_counters(events: DataFrame, half_life: float = 30 * 86400.0) -> DataFrame:
    """A stream of (key, at in seconds): each key's decayed count after every batch."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=DecayedCounter(half_life), outputStructType="key string, value double, at double", outputMode="update", timeMode="none")
