"""Row counts of a run's stages, taken while the run's own job goes through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Counts rows at named places of a plan.

    ``watch`` returns the table with a counter on it; when the plan has run (one action on a
    table that all watched ones lead to), ``rows`` has the counts, without a job of their
    own. A place counts the rows that go through it: a limit further on that stops early
    leaves rows uncounted.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        if stage in self._seen:
            raise ValueError(f"stage {stage!r} is watched already")
        self._seen[stage] = Observation(stage)
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"))

    def rows(self) -> dict[str, int]:
        """Stage → rows, in the order in which stages were named. Waits for the action."""
        return {stage: seen.get["rows"] for stage, seen in self._seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, n_rows), one row for each stage."""
        return spark.createDataFrame(list(self.rows().items()), "stage string, n_rows long")


def watched(counts: StageCounts | None, df: DataFrame | None, stage: str) -> DataFrame | None:
    """``df`` counted as ``stage``, where there is a table and something to count with."""
    return df if counts is None or df is None else counts.watch(df, stage)
