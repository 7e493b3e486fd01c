"""Sums of vectors of a fixed length over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECE = 4096
SALTS = 512


def summed(rows: DataFrame, per_task: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum of the vectors of ``size`` long numbers that ``per_task`` yields, one per task as a rule.

    Vectors travel in pieces, of which those without any count are left out. Each piece is added up in two steps, first
    over the tasks of one salt, so no group grows beyond tasks / ``SALTS`` or ``SALTS`` pieces, and the driver gets
    one vector whatever the number of tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for vector in per_task(batches):
            pieces = [(i, vector[i : i + PIECE]) for i in range(0, size, PIECE)]
            salt = TaskContext.get().partitionId() % SALTS
            yield pd.DataFrame([(i, salt, x.astype("<i8").tobytes()) for i, x in pieces if x.any()], columns=["i", "salt", "v"])

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<i8") for v in group["v"])
        return pd.DataFrame({"i": [key[0]], "salt": [key[-1]], "v": [total.tobytes()]})

    schema = "i long, salt long, v binary"
    total = np.zeros(size, np.int64)
    parts = rows.mapInPandas(run, schema).groupBy("i", "salt").applyInPandas(add, schema)
    for r in parts.groupBy("i").applyInPandas(add, schema).collect():
        total[r["i"] : r["i"] + PIECE] = np.frombuffer(r["v"], "<i8")
    return total
