"""Numbers of rows that a job takes on its way, without a pass of their own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Counts:
    """Counts observed while the watched tables are computed, by name.

    Each table is watched by one observation; the numbers are there once an action has run over it. A task that runs again
    after a lost executor may be counted twice: the counts are a report, and no result depends on them.
    """

    _seen: list[tuple[tuple[str, ...], Observation]] = field(default_factory=list)

    def watch(self, df: DataFrame, **conditions: Column | None) -> DataFrame:
        """``df`` itself; counts, under each name, the rows that meet the condition (all rows for None)."""
        observation = Observation()
        self._seen.append((tuple(conditions), observation))
        return df.observe(observation, *[F.count_if(F.lit(True) if c is None else F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])

    def values(self) -> dict[str, int]:
        """All counts so far; those of tables watched under one name are added up. Waits for tables that are not computed yet."""
        total: dict[str, int] = {}
        for names, observation in self._seen:
            found = observation.get
            for n in names:
                total[n] = total.get(n, 0) + int(found[n])
        return total


def n_rows(df: DataFrame) -> int:
    """Rows of a table, counted as a job counts them on its way."""
    counts = Counts()
    counts.watch(df.select(), n=None).write.format("noop").mode("overwrite").save()
    return counts.values()["n"]
