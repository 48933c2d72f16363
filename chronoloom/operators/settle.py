"""Greedy choices along a stream, settled block by block.

A greedy walk takes the events of a stream by falling rank; what an event gets depends only on the
better ones within ``reach`` of it, on what those got, and so on. A chunk of the stream (a time block
with a halo on both sides) therefore settles almost all of its events by itself: a walk that knows
which events lie too near the chunk's edges carries that doubt along and decides exactly the events
which no unseen event can change. What stays open goes into another round on blocks that are shifted
and four times as long. A decision is never guessed, so the result is that of one walk over the whole
stream; usually one round leaves nothing open.

The rounds end because the blocks outgrow the stream. A stream whose ranks fall (or rise) without a
break over many blocks is the worst case: its events depend on each other one by one, stay open round
after round and are at last walked in one chunk, in the memory of a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.session import materialise
from chronoloom.timekeys import floor_div

OPEN, CHOSEN, GONE, NOTHING = 0, 1, 2, -1


def changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which a key-sorted frame begins another group, null being a value of its own."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        c = pdf[k]
        a, b = c.to_numpy()[1:], c.to_numpy()[:-1]
        none = c.isna().to_numpy()
        with np.errstate(invalid="ignore"):
            new[1:] |= (np.asarray(a != b, bool) & ~(none[1:] & none[:-1])) | (none[1:] != none[:-1])
    return np.flatnonzero(new)


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of a key-sorted partition, one frame holding many groups; only the last, perhaps
    unfinished, group waits for the next batch."""
    parts: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        both = pd.concat([parts[-1].iloc[-1:], pdf], ignore_index=True) if parts else pdf
        starts = changes(both, keys)[1:] - (1 if parts else 0)
        if len(starts):
            cut = int(starts[-1])
            whole = [*parts, pdf.iloc[:cut]] if cut else parts
            yield pd.concat(whole, ignore_index=True) if len(whole) > 1 else whole[0].reset_index(drop=True)
            parts = [pdf.iloc[cut:]]
        else:
            parts.append(pdf)
    if parts:
        yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)


def settle(
    events: DataFrame,
    keys: list[str],
    ident: list[str],
    at: str,
    reach: int,
    walk: Callable[[pd.DataFrame, np.ndarray], dict[str, np.ndarray]],
    extra: str = "",
    *,
    block: int | None = None,
    halo: int | None = None,
    small: int = 100_000,
) -> DataFrame:
    """The chosen events of ``events`` with the columns of ``extra`` that the walk gives them.

    ``walk`` gets one chunk, sorted by (at, ident), and which of its rows are complete (all rows within
    ``reach`` of them lie in the chunk). It returns ``state`` (OPEN, CHOSEN, GONE or, for rows that
    are none of its own decisions, NOTHING) and the extra columns. ident tells the rows of a key apart;
    at must not be null. Runs one job per round; fewer than ``small`` open rows are settled per key.
    """
    block, halo = block or 96 * reach, halo or 6 * reach
    names = list(events.columns)
    schema = T.StructType([*events.schema.fields, *(T._parse_datatype_string(extra).fields if extra else []), T.StructField("__state", T.ByteType()), T.StructField("__core", T.BooleanType())])
    added = [f.name for f in schema if f.name not in names and not f.name.startswith("__")]

    def one_round(rows: DataFrame, size: int | None, shift: int) -> DataFrame:
        if size is None:
            cut = rows.withColumn("__blk", F.lit(0).cast("bigint"))
        else:
            from_, to = floor_div(F.col(at) - F.lit(shift + halo), size), floor_div(F.col(at) - F.lit(shift - halo), size)
            cut = rows.withColumn("__blk", F.explode(F.sequence(from_, to)))
        group = [*keys, "__blk"]
        cut = cut.repartition(*group).sortWithinPartitions(*group, at, *ident)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in runs_of(batches, group):
                starts = changes(pdf, group)
                ends = np.append(starts[1:], len(pdf))
                when = pdf[at].to_numpy()
                blk = pdf["__blk"].to_numpy()
                out = []
                for a, b in zip(starts, ends):
                    part = pdf.iloc[a:b]
                    t = when[a:b]
                    if size is None:
                        sure = core = np.ones(b - a, bool)
                    else:
                        low = int(blk[a]) * size + shift
                        sure = (t - reach >= low - halo) & (t + reach < low + size + halo)
                        core = (t >= low) & (t < low + size)
                        if not core.any():
                            continue  # its neighbours decide
                    got = walk(part, sure)
                    state = got["state"]
                    keep = (core & ((state == OPEN) | (state == CHOSEN))) | (~core & ((state == CHOSEN) | (state == GONE)))
                    if keep.any():
                        rows = {n: part[n].to_numpy()[keep] for n in names}
                        rows |= {n: got[n][keep] for n in added}
                        out.append(pd.DataFrame(rows | {"__state": state[keep].astype(np.int8), "__core": core[keep]}))
                if out:
                    yield pd.concat(out, ignore_index=True)

        return materialise(cut.mapInPandas(run, schema))

    out, rows, size, shift = None, events, block, 0
    while True:
        done = one_round(rows, size, shift)
        own = done.filter("__core")
        chosen = own.filter(F.col("__state") == CHOSEN).select(*names, *added)
        out = chosen if out is None else out.unionByName(chosen)
        still = own.filter(F.col("__state") == OPEN).select(*names)
        if size is None or still.isEmpty():
            return out
        # What a neighbouring chunk could decide about an open row of another block.
        told = done.filter("not __core").groupBy(*keys, *ident).agg(F.max(F.struct("__state", *added)).alias("__told"))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*keys, *ident)]
        met = still.alias("o").join(told.alias("t"), same, "left").select("o.*", "__told")
        met = materialise(met)
        out = out.unionByName(met.filter(F.col("__told.__state") == CHOSEN).select(*names, *[F.col(f"__told.{c}").alias(c) for c in added]))
        rows = met.filter("__told is null").select(*names)
        left = rows.limit(small + 1).count()
        if not left:
            return out
        size, shift = (None, 0) if left <= small else (4 * size, shift + size // 2)
