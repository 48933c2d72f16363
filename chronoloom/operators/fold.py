"""Order-dependent state as one fold per key, the same step in batch and in streaming.

A Fold has an initial state and a step(state, row) -> rows that changes the state in place. In batch
a key-sorted partition streams through Arrow batches and only the state of the current key is held,
so the length of a key never matters for memory; in streaming the state lives in the state store
between micro-batches (see chronoloom.streaming.stateful).
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Fold:
    """init() -> state (plain, picklable); step(state, row) yields output tuples without the key; flush at a key's end."""

    init: Callable[[], Any]
    step: Callable[[Any, Any], Iterable[tuple]]
    output: str
    flush: Callable[[Any], Iterable[tuple]] | None = None


def _none(v: Any) -> Any:
    return None if v is pd.NaT or (isinstance(v, float) and v != v) else v


def values(column: pd.Series) -> list:
    """A batch's column as plain values, None for null and NaN."""
    if column.dtype.kind in "iub":
        return column.tolist()
    if column.dtype.kind == "f":
        out = column.tolist()
        for i in np.flatnonzero(np.isnan(column.to_numpy())).tolist():
            out[i] = None
        return out
    return [_none(v) for v in column.tolist()]


def row_type(names: list[str]) -> type:
    return namedtuple("Row", names, rename=True)


def frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame whose columns keep nulls apart from NaN-coerced integers."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pd.DataFrame({f.name: pd.Series(list(c), dtype=object) for f, c in zip(schema, columns)})


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """(keys, output): the fold over each key's rows in order (give an order without ties).

    Rows with a null key form a key of their own. Rows reach the step as named tuples with None for
    null and NaN. An empty table gives no rows.
    """
    out = T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(fold.output).fields])
    names = list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        make = row_type(names)._make
        at = [names.index(k) for k in keys]
        for pdf in batches:
            rows: list[tuple] = []
            for row in map(make, zip(*(values(pdf[c]) for c in names))):
                key = tuple(row[i] for i in at)
                if key != current:
                    if current is not None and fold.flush:
                        rows += [current + tuple(x) for x in fold.flush(state)]
                    current, state = key, fold.init()
                rows += [key + tuple(x) for x in fold.step(state, row)]
            yield frame(rows, out)
        if current is not None and fold.flush:
            yield frame([current + tuple(x) for x in fold.flush(state)], out)

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, out)
