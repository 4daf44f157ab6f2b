"""Rules with a state (short, flat, long) as finite maps: a row says what becomes of each state, and maps compose.

Composition is associative, so a sequence needs no loop over its rows: log2(n) array steps inside a block, one map a block between
blocks. States are numbered 0 (short), 1 (flat) and 2 (long).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096
FLAT = 1


def composed(maps: np.ndarray) -> np.ndarray:
    """(row, state): the state after each row, for each state before the first one. ``maps`` is (row, state before)."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], 1)
        step *= 2
    return out


def sided(short: np.ndarray, flat: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Maps from what a row makes of a short, a flat and a long position, as -1, 0 and 1."""
    return np.stack([short, flat, long], 1).astype(np.int64) + 1


def walked(rows: DataFrame, order: str, maps: Callable[[pd.DataFrame], np.ndarray], name: str = "position", key: str = "series") -> DataFrame:
    """``rows`` with a column of -1.0, 0.0 or 1.0: the state after each row of a key, flat before the first.

    Blocks of rows are reduced to one map each, the maps of a key are composed over one row a block, and each block is
    finished from the state it begins with.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = rows.columns
    numbered = rows.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / BLOCK))

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        last = composed(maps(group.sort_values(order)))[-1]
        return pd.DataFrame({key: group[key].iloc[:1], "_block": group["_block"].iloc[:1], "_map": [last.tolist()]})

    def begin(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_block")
        after = composed(np.stack(group["_map"].to_list()))[:, FLAT]
        return pd.DataFrame({key: group[key], "_block": group["_block"], "_begin": np.append(FLAT, after[:-1])})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        state = composed(maps(group))[:, int(group["_begin"].iloc[0])]
        return group[names].assign(**{name: state - 1.0})

    reduced = numbered.groupBy(key, "_block").applyInPandas(reduce, f"{key} {kind}, _block long, _map array<long>")
    begins = reduced.groupBy(key).applyInPandas(begin, f"{key} {kind}, _block long, _begin long")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != name) + f", {name} double"
    return numbered.join(begins, [key, "_block"]).groupBy(key, "_block").applyInPandas(finish, schema)
