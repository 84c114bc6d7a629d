"""The report of a run: what each phase took and how many rows it left."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


class Run:
    def __init__(self) -> None:
        self._phases: list[tuple[str, float, int]] = []
        self._since = time.time()

    def add(self, phase: str, rows: DataFrame) -> None:
        """Close a phase whose result is ``rows`` (a stored table, so counting is cheap)."""
        n = rows.count()
        now = time.time()
        self._phases.append((phase, now - self._since, n))
        self._since = now

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._phases, "phase string, seconds double, rows long")
