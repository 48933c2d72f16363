"""A Fold over a stream: its state lives in the state store between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.fold import Fold, frame, row_type, values


def stream_fold(df: DataFrame, keys: list[str], order: list[str], fold: Fold, *, idle_ms: int | None = None) -> DataFrame:
    """(keys, output) in append mode: the same rows as ordered_fold, as long as a later micro-batch
    never holds an earlier row of a key (late rows are folded when they come).

    With ``idle_ms`` a key that gets no rows for so long is flushed and its state dropped.
    """
    out = T.StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(fold.output).fields])
    names = list(df.columns)
    state_type = T.StructType([T.StructField("s", T.BinaryType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(group.get[0]) if group.exists else fold.init()
        if group.hasTimedOut:
            group.remove()
            yield frame([key + tuple(x) for x in fold.flush(state)] if fold.flush else [], out)
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        rows = [key + tuple(x) for row in map(row_type(names)._make, zip(*(values(pdf[c]) for c in names))) for x in fold.step(state, row)]
        group.update((pickle.dumps(state),))
        if idle_ms:
            group.setTimeoutDuration(idle_ms)
        yield frame(rows, out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(*[F.col(k) for k in keys]).applyInPandasWithState(run, out, state_type, "append", timeout)
