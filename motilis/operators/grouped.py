"""Small groups through numpy, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def over_whole_groups(rows: DataFrame, key: str, order: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over frames of whole groups, rows of a group together and in order. Rows without a key are left out.

    A call of applyInPandas for every group costs a millisecond or more, whatever is in it; here one call takes the groups of a whole Arrow batch.
    The window brings a group's rows together, without a shuffle where they are together already. Memory: a batch and the largest group."""

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            # the batch's last group may go on in the next one
            cut = int(starts(keys)[-2])
            if cut:
                yield run(pd.concat([*held, pdf[:cut]], ignore_index=True))
                held = []
            elif held and last != keys[0]:
                yield run(pd.concat(held, ignore_index=True))
                held = []
            held.append(pdf[cut:])
            last = keys[-1]
        if held:
            yield run(pd.concat(held, ignore_index=True))

    w = Window.partitionBy(key).orderBy(order)
    return rows.filter(F.col(key).isNotNull()).withColumn("__nth", F.row_number().over(w)).mapInPandas(frames, schema)
