"""The greedy one-to-one matching of two streams for many circular shifts of one of them, as counts.

No arrangement is written out. The left stream is cut into time slabs, the shifts into groups of near
ones, and a task gets one slab and the packed stretch of the right stream that a group's shifts bring
there; it rotates that stretch in memory, shift by shift. What moves is each stream once per group of
shifts, however many shifts there are.

A slab is matched whole once the rights are gone that lefts beyond its borders take. Those come from
the strip around a border, matched twice: once as if no unseen left competed there, once as if unseen
lefts took all they can reach. The truth lies between the two for every left, so where both agree they
are the truth. Shifts for which they don't are done again with longer strips and slabs, at last in one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.settle import changes, runs_of
from chronoloom.timekeys import floor_div

_FAR = np.int64(1) << 62
_GROUPS = 6  # of shifts; each moves both streams once
_CELLS = 32  # packed pieces of a slab


def batches(t: np.ndarray, share: int = 6, least: int = 2048) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Lefts in rank order, cut into (begin, end, which have stronger ones of the same time in the batch, how many)."""
    out, begin = [], 0
    while begin < len(t):
        size = min(len(t) - begin, max(least, (len(t) - begin) // share))
        order = np.argsort(t[begin : begin + size], kind="stable")
        when, at = t[begin : begin + size][order], np.arange(size)
        nth = np.empty(size, np.int64)
        nth[order] = at - np.maximum.accumulate(np.where(np.append(True, when[1:] != when[:-1]), at, 0))
        late = np.flatnonzero(nth)
        out.append((begin, begin + size, late, nth[late]))
        begin += size
    return out


def nearest_free(t: np.ndarray, parts: list[tuple[int, int, np.ndarray, np.ndarray]], at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For lefts ``t`` in rank order the index of the right each takes: the nearest free one within the
    window, of equally near ones that of the higher id; -1 for none. ``at`` is sorted, by id within a time.

    Batch by batch, whole batches at once: everybody asks for the best right not yet asked, each right keeps its
    strongest asker, the others ask on. The order of asking does not change who ends where.
    """
    mate, free = np.full(len(t), -1), np.arange(len(at))
    for begin, end, late, nth in parts:
        m, size = len(free), end - begin
        if not m:
            break
        mine, there = t[begin:end], at[free]
        # Index 0 and m + 1 stand for "none". Going back, a time's highest id comes first by itself; going on, by flip.
        time = np.concatenate([[-_FAR], there, [_FAR]])
        name = np.concatenate([[0], ids[free], [0]])
        flip = np.arange(m + 2)
        if (there[1:] == there[:-1]).any():
            first = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
            long = np.diff(np.append(first, m))
            flip[1:-1] = np.repeat(2 * first + long - 1, long) - np.arange(m) + 1
        on = np.searchsorted(there, mine, side="left") + 1
        back = on - 1
        if len(late):
            # Lefts of one time want the same: the n-th of them gets none of the first n - 1 choices. low: how many of those lie before it.
            x, b, f, low, high = mine[late], back[late], on[late], np.zeros_like(nth), nth.copy()
            for _ in range(int(nth.max()).bit_length()):
                i = (low + high) >> 1
                p, q = np.maximum(b - i, 0), flip[np.minimum(f + (nth - 1 - i), m + 1)]
                dp, dq = x - time[p], time[q] - x
                before = ((dp < dq) | ((dp == dq) & (name[p] >= name[q]))) & (i < nth)
                low, high = np.where(before, i + 1, low), np.where(before, high, np.maximum(i, low))
            back[late], on[late] = np.maximum(b - low, 0), np.minimum(f + (nth - low), m + 1)
        holder, asking = np.full(m + 2, size), np.arange(size)
        while len(asking):
            x, p, f = mine[asking], back[asking], on[asking]
            q = flip[f]
            dp, dq = x - time[p], time[q] - x
            before = dp < dq
            tie = np.flatnonzero((dp == dq) & (dp <= window))
            before[tie] = name[p[tie]] >= name[q[tie]]
            back[asking], on[asking] = p - before, f + ~before
            near = np.minimum(dp, dq) <= window
            asking, want = asking[near], np.where(before, p, q)[near]
            held = holder[want]
            better = asking < held
            who, what, held = asking[better], want[better], held[better]
            holder[what[::-1]] = who[::-1]  # the strongest is written last
            won = holder[what] == who
            lost = held[won]
            asking = np.sort(np.concatenate([asking[~better], who[~won], lost[lost < size]]))
        got = holder[1:-1] < size
        mate[begin + holder[1:-1][got]] = free[got]
        free = free[~got]
    return mate


class _Border:
    """Who takes what around one border of a slab, of the lefts beyond it."""

    def __init__(self, t: np.ndarray, cut: int, below: bool, window: int, halo: int):
        self.low, self.high, self.window = cut - halo, cut + halo, window
        self.all = t[(t >= self.low) & (t < self.high)]
        self.sure = np.flatnonzero((self.all - window >= self.low) & (self.all + window < self.high))
        inside = self.all[self.sure]
        self.asked = np.flatnonzero((inside >= cut - 2 * window) & (inside < cut) if below else (inside >= cut) & (inside < cut + 2 * window))
        self.parts, self.sure_parts = batches(self.all), batches(inside)

    def taken(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray | None:
        """Indices of the rights that lefts beyond the border take; None where unseen events could change that."""
        a, b = np.searchsorted(at, [self.low, self.high])
        best = nearest_free(self.all[self.sure], self.sure_parts, at[a:b], ids[a:b], self.window)[self.asked]
        c, d = np.searchsorted(at, [self.low + self.window, self.high - self.window])
        worst = nearest_free(self.all, self.parts, at[c:d], ids[c:d], self.window)[self.sure[self.asked]]
        best, worst = np.where(best < 0, -1, best + a), np.where(worst < 0, -1, worst + c)
        return best[best >= 0] if (best == worst).all() else None


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte values, equal bytes of a column next to each other."""
    cells = np.stack([np.ascontiguousarray(c).view(np.int64) for c in columns])
    return zlib.compress(cells.view(np.uint8).reshape(*cells.shape, 8).transpose(0, 2, 1).tobytes(), 1)


def _unpacked(bodies: list[bytes], n: int) -> np.ndarray:
    cells = [np.frombuffer(zlib.decompress(b), np.uint8).reshape(n, 8, -1).transpose(0, 2, 1).copy().view(np.int64)[..., 0] for b in bodies]
    return np.concatenate(cells, axis=1) if cells else np.zeros((n, 0), np.int64)


def rotated_counts(left: DataFrame, right: DataFrame, shifts: list[int], window: int, *, duration: int, tight: int, slabs: int, halo: int) -> dict[int, tuple[int, int, int, int]]:
    """For each shift the pairs, those at most ``tight`` apart, those of one time, and the sum of |dt|; nothing without events.

    left and right have id, ms and strength as bigint, bigint and double without null id or ms; repeated
    rows are one event. Rights are put at (ms + shift) mod duration, lefts stay. Runs a job, and one
    more for each time that strips were too short.
    """
    done: dict[int, tuple[int, int, int, int]] = {}
    open_ = sorted(set(shifts))
    while open_:
        slabs = max(1, min(slabs, duration // (4 * halo)))
        got = _round(left, right, open_, window, duration, tight, slabs, halo)
        by = got.groupBy("shift").agg(*[F.sum(c).alias(c) for c in ("n", "t", "z", "away", "open")]).collect()
        done |= {x["shift"]: (x["n"], x["t"], x["z"], x["away"]) for x in by if not x["open"]}
        open_ = sorted(x["shift"] for x in by if x["open"])
        slabs, halo = slabs // 4, 4 * halo
    return done


def _round(left: DataFrame, right: DataFrame, shifts: list[int], window: int, duration: int, tight: int, slabs: int, halo: int) -> DataFrame:
    cuts = [duration * i // slabs for i in range(slabs + 1)]
    groups = [[int(s) for s in g] for g in np.array_split(np.array(shifts), min(_GROUPS, len(shifts)))]
    cell = max(1, duration // (slabs * _CELLS))
    seen = [(cuts[i] - halo if i else 0, cuts[i + 1] + halo if i + 1 < slabs else duration) for i in range(slabs)]

    def tasks_of(side: int, start: int) -> Iterator[int]:
        """The tasks that need a cell of a side; task = slab * number of groups + group."""
        for i, (low, high) in enumerate(seen):
            # Lefts before the first and after the last slab belong to it.
            if side == 0 and ((start + cell > low or not i) and (start < high or i + 1 == slabs)):
                yield from range(i * len(groups), (i + 1) * len(groups))
            for g, own in enumerate(groups if side else []):
                from_, long = low - own[-1], high - low + own[-1] - own[0]
                if (start - from_) % duration < long or (from_ - start) % duration < cell:
                    yield i * len(groups) + g

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of(frames, ["side", "cell"]):
            starts = changes(pdf, ["side", "cell"])
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                ms, ids, strength = (pdf[c].to_numpy()[a:b] for c in ("ms", "id", "strength"))
                strength = np.where(np.isnan(strength), -np.inf, strength)
                order = np.lexsort((strength, ids, ms))
                ms, ids, strength = ms[order], ids[order], strength[order]
                new = np.append(True, (ms[1:] != ms[:-1]) | (ids[1:] != ids[:-1]) | (strength[1:] != strength[:-1]))
                side, at = int(pdf["side"].iloc[a]), int(pdf["cell"].iloc[a]) * cell
                body = _packed(*([ms[new], ids[new]] if side else [ms[new], ids[new], strength[new]]))
                out += [(task, side, at, body) for task in tasks_of(side, at)]
            if out:
                yield pd.DataFrame(out, columns=["task", "side", "at", "body"])

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tasks: dict[int, list[tuple[int, int, bytes]]] = {}
        for pdf in frames:
            for task, *piece in pdf.itertuples(index=False, name=None):
                tasks.setdefault(task, []).append(tuple(piece))
        for task in sorted(tasks):
            counts = one(*divmod(task, len(groups)), sorted(tasks.pop(task)))
            yield pd.DataFrame(counts, columns=["shift", "n", "t", "z", "away", "open"])

    def one(i: int, g: int, pieces: list[tuple[int, int, bytes]]) -> list[tuple[int, ...]]:
        t, ids, strength = _unpacked([body for side, _, body in pieces if side == 0], 3)
        base, names = _unpacked([body for side, _, body in pieces if side == 1], 2)
        t = t[np.lexsort((t, ids, -strength.view(np.float64)))]
        low, high = cuts[i] if i else -_FAR, cuts[i + 1] if i + 1 < slabs else _FAR
        borders = [_Border(t, cuts[i], True, window, halo)] if i else []
        borders += [_Border(t, cuts[i + 1], False, window, halo)] if i + 1 < slabs else []
        own = t[(t >= low) & (t < high)]
        parts = batches(own)
        out = []
        for s in groups[g]:
            turn = np.searchsorted(base, duration - s)
            at, who = np.concatenate([base[turn:] + (s - duration), base[:turn] + s]), np.concatenate([names[turn:], names[:turn]])
            taken = [x.taken(at, who) for x in borders]
            if any(x is None for x in taken):
                out.append((s, 0, 0, 0, 0, 1))
                continue
            a, b = np.searchsorted(at, [low - window if i else low, high + window if i + 1 < slabs else high])
            free = np.ones(len(at), bool)
            for x in taken:
                free[x] = False
            at, who = at[a:b][free[a:b]], who[a:b][free[a:b]]
            mate = nearest_free(own, parts, at, who, window)
            away = np.abs(own - at[mate])[mate >= 0] if len(at) else own[:0]
            out.append((s, len(away), int((away <= tight).sum()), int((away == 0).sum()), int(away.sum()), 0))
        return out

    # Rights lie at 0 .. duration under every shift, so lefts farther off than the window have none.
    near = left.filter((F.col("ms") >= F.lit(-window)) & (F.col("ms") < F.lit(duration + window)))
    both = near.withColumn("side", F.lit(0)).unionByName(right.withColumn("ms", F.pmod("ms", F.lit(duration).cast("bigint"))).withColumn("side", F.lit(1)))
    cells = both.withColumn("cell", floor_div("ms", cell)).repartition("side", "cell").sortWithinPartitions("side", "cell")
    sent = cells.mapInPandas(pack, "task int, side int, at bigint, body binary")
    return sent.repartitionById(slabs * len(groups), F.col("task")).mapInPandas(match, "shift bigint, n bigint, t bigint, z bigint, away bigint, open bigint")
