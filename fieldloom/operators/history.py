"""UNDO: snapshots of an edited table. DataFrames are immutable plans, so a snapshot costs nothing until read."""

from __future__ import annotations

from pyspark.sql import DataFrame


class EditHistory:
    """A commit cuts what could be redone; undo and redo stop at the ends."""

    def __init__(self, first: DataFrame) -> None:
        self.states, self.at = [first], 0

    @property
    def current(self) -> DataFrame:
        return self.states[self.at]

    def commit(self, state: DataFrame) -> DataFrame:
        self.states = [*self.states[: self.at + 1], state]
        self.at += 1
        return state

    def undo(self) -> DataFrame:
        self.at = max(self.at - 1, 0)
        return self.current

    def redo(self) -> DataFrame:
        self.at = min(self.at + 1, len(self.states) - 1)
        return self.current
