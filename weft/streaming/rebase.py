"""A stream of edits in any order, rebased onto what has been applied; the state is that of the whole log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "graph string, item string, other string, live boolean, weight double, swallowed long, ops long, rekey boolean"


class Rebase(StatefulProcessor):
    """State for each graph: the first removal of a path, which paths were added, the last write of an
    edge, the first clock at which it was written, the neighbours of a path, and a count of edits.

    An edit that a removal or a later write has overtaken is swallowed.  After a batch the paths and edges
    that it touched go out with what they are now: a later row for the same (item, other) replaces an
    earlier one.  Every ``interval`` edits ``rekey`` says that derived data are to be rebuilt.
    """

    def __init__(self, interval: int = 128):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.removed = handle.getMapState("removed", "path string", "lamport long, peer string")
        self.added = handle.getMapState("added", "path string", "yes boolean")
        self.edges = handle.getMapState("edges", "a string, b string", "lamport long, peer string, weight double, first_lamport long, first_peer string")
        self.around = handle.getMapState("around", "path string", "others array<string>")
        self.ops = handle.getValueState("ops", "n long")

    def _gone(self, path: str):
        found = self.removed.getValue((path,)) if self.removed.containsKey((path,)) else None
        return tuple(found) if found else None

    def _others(self, path: str) -> list[str]:
        return list(self.around.getValue((path,))[0]) if self.around.containsKey((path,)) else []

    def _live(self, path: str) -> bool:
        """Added, or an end of an edge that came before the other end's removal; and not removed."""
        if self._gone(path):
            return False
        if self.added.containsKey((path,)):
            return True
        for other in self._others(path):
            edge, gone = self.edges.getValue((min(path, other), max(path, other))), self._gone(other)
            if gone is None or (edge[3], edge[4]) < gone:
                return True
        return False

    def _apply(self, clock, kind, a, b, weight, touched) -> bool:
        """Applies an edit; true if nothing of it is left."""
        if kind == "add":
            self.added.updateValue((a,), (True,))
            touched.add((a, None))
            return self._gone(a) is not None
        if kind == "remove":
            before = self._gone(a)
            if before is None or clock < before:
                self.removed.updateValue((a,), clock)
            touched.add((a, None))
            for other in self._others(a):
                touched |= {(other, None), (min(a, other), max(a, other))}
            return before is not None
        if kind != "set_edge":
            return True
        key = (min(a, b), max(a, b))
        old = tuple(self.edges.getValue(key)) if self.edges.containsKey(key) else None
        last = (*clock, weight) if old is None or clock > old[:2] else old[:3]
        first = clock if old is None else min(clock, old[3:])
        self.edges.updateValue(key, (*last, *first))
        if old is None:
            for x, y in ((a, b), (b, a)):
                self.around.updateValue((x,), (sorted({*self._others(x), y}),))
        touched |= {(a, None), (b, None), key}
        return last[:2] != clock or self._gone(a) is not None or self._gone(b) is not None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, touched, swallowed = self.ops.get(), set(), 0
        before = ops = int(found[0]) if found else 0
        for batch in rows:
            for r in batch.itertuples(index=False):
                ops += 1
                swallowed += self._apply((int(r.lamport), r.peer), r.kind, r.path_a, r.path_b, None if pd.isna(r.weight) else float(r.weight), touched)
        self.ops.update((ops,))
        rekey = before // self.interval != ops // self.interval
        out = []
        for item, other in sorted(touched, key=str):
            if other is None:
                out.append((key[0], item, None, self._live(item), None, swallowed, ops, rekey))
            else:
                live = self._gone(item) is None and self._gone(other) is None
                out.append((key[0], item, other, live, self.edges.getValue((item, other))[2] if live else None, swallowed, ops, rekey))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def rebased(edits: DataFrame, interval: int = 128) -> DataFrame:
    """A stream of (graph, lamport, peer, kind, path_a, path_b, weight), each edit delivered once."""
    return edits.groupBy("graph").transformWithStateInPandas(statefulProcessor=Rebase(interval), outputStructType=OUTPUT, outputMode="update", timeMode="none")
