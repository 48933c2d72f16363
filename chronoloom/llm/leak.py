"""Evaluation passages inside training documents: q-gram lemma, diagonal bands, banded alignment.

Texts are compared as words: consistent form (see lookalike), lower case, runs of letters or digits,
one space between. A window of ``min_words`` words of an item that lies in a document with at most e
edits shares at least L + 1 - q - q e character q-grams with it, all within e + 1 neighbouring
diagonals (document position minus item position). q is chosen from the edit budget so that this bound
is at least 1 for every window; where no q is, the call is refused. Per document the shared q-grams are
counted in overlapping bands of 2 (e + 1) diagonals; regions of bands that reach the bound are verified by an
alignment confined to band and region, which tells every window found and its edits.

A window that several items share is indexed once, with the set of its items: an instruction line in
front of a thousand items is one passage, searched and aligned once, and only its result rows number a
thousand.

Items are the stated query set: they travel to the executors in blocks of at most ``block_chars``
characters, each block being one pass over the documents' words, so what is broadcast never grows beyond
a block. With more than one block the words are written out once. Documents are never shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronoloom.llm.lookalike import caseless_sql, connect, look_alikes, mapped
from chronoloom.session import materialise

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 30
CELLS = 2_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def _word_signs() -> np.ndarray:
    """Which code points are letters, digits or marks."""
    out = np.zeros(0x110000, bool)
    out[:0x33480] = [unicodedata.category(c)[0] in "LNM" for c in map(chr, range(0x33480))]  # no letters above
    out[0xE0100:0xE01F0] = True  # marks
    return out


def _spaced(text: str) -> np.ndarray:
    """The words of a text as codes, each with one space before and after; nothing without words."""
    codes = _codes(text)
    at = np.flatnonzero(_word_signs()[codes])
    if not len(at):
        return np.empty(0, np.uint32)
    out = np.full(len(at) + int((np.diff(at) > 1).sum()) + 2, 32, np.uint32)
    out[np.arange(1, len(at) + 1) + np.concatenate(([0], np.cumsum(np.diff(at) > 1)))] = codes[at]
    return out


def _words(con, texts: list[str], sql: str) -> list[str]:
    return [_spaced(t).tobytes().decode("utf-32-le", "surrogatepass") for t in mapped(con, texts, sql)]


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram of one array, by position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, have = codes.astype(np.uint64), 1
    power = _BASE
    parts = []  # (length, hashes, base ** length): powers of two put together as q's binary digits say
    while have <= q:
        parts.append((have, h, power))
        if 2 * have <= q:
            h = h[: len(h) - have] * power + h[have:]
        power = np.uint64((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
        have *= 2
    out, done = None, 0
    for size, x, power in reversed(parts):
        if q & size:
            out = x[:n].copy() if out is None else out * power + x[done : done + n]
            done += size
    out ^= out >> np.uint64(29)
    out *= _BASE
    return out


@dataclass
class _Index:
    """Q-grams of passages: sorted hashes, postings (passage, position), a prefilter, windows and their items."""

    q: int
    texts: list[np.ndarray]
    need: list[np.ndarray]  # by end position: length of the window that ends there, or a length never reached
    group: list[np.ndarray]  # by end position: the item set of that window
    longest: np.ndarray  # longest window, by passage
    bound: np.ndarray  # least number of shared q-grams, by passage
    grams: np.ndarray
    start: np.ndarray
    passage: np.ndarray
    pos: np.ndarray
    bits: np.ndarray

    @classmethod
    def build(cls, q: int, passages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], max_edits: int) -> _Index:
        texts = [p[0] for p in passages]
        real = [p[1][p[1] < _FAR] for p in passages]
        bound = np.array([int(x.min()) + 1 - q - q * max_edits for x in real], np.int64)
        h = [_gram_hashes(t, q) for t in texts]
        every = np.concatenate(h)
        passage = np.repeat(np.arange(len(texts)), [len(x) for x in h])
        pos = np.concatenate([np.arange(len(x)) for x in h])
        order = np.argsort(every, kind="stable")
        grams, start = np.unique(every[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[(grams >> np.uint64(44)).astype(np.int64)] = True
        return cls(q, texts, [p[1] for p in passages], [p[2] for p in passages], np.array([int(x.max()) for x in real]), bound, grams, np.append(start, len(order)), passage[order], pos[order], bits)


@dataclass
class _Block:
    """One block of items: an index for each q that its windows need, and the items of each item set."""

    indexes: list[_Index]
    sets: list[list]

    @classmethod
    def build(cls, items: list[tuple], min_words: int, max_edits: int, q: int) -> _Block | None:
        of_window: dict[str, list[int]] = {}  # a window's items, each once
        cut: list[tuple[str, list[int], np.ndarray]] = []
        for n, (_, words) in enumerate(items):
            gaps = np.flatnonzero(_codes(words) == 32)
            ends = gaps[min_words:] + 1
            new = np.zeros(len(ends), bool)
            for k, (a, b) in enumerate(zip(gaps.tolist(), ends.tolist())):
                seen = of_window.setdefault(words[a:b], [])
                new[k] = not seen
                if not seen or seen[-1] != n:
                    seen.append(n)
            cut.append((words, gaps.tolist(), new))
        if not of_window:
            return None
        sets: dict[tuple[int, ...], int] = {}
        by_q: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for words, gaps, new in cut:
            firsts = np.flatnonzero(new & ~np.concatenate(([False], new[:-1])))
            lasts = np.flatnonzero(new & ~np.concatenate((new[1:], [False])))
            for i, j in zip(firsts.tolist(), lasts.tolist()):  # a passage: windows not seen before, one after another
                begin, end = gaps[i], gaps[j + min_words] + 1
                text = words[begin:end]
                need, group = np.full(end - begin + 1, _FAR, np.int64), np.zeros(end - begin + 1, np.int64)
                for k in range(i, j + 1):
                    at = gaps[k + min_words] + 1
                    need[at - begin] = at - gaps[k]
                    group[at - begin] = sets.setdefault(tuple(of_window[words[gaps[k] : at]]), len(sets))
                least = int(need.min())
                own = q
                while own > 1 and least + 1 - own - own * max_edits < 1:
                    own -= 2
                if own < 2:
                    raise ValueError(f"{max_edits} edits are too many to find windows of {least} characters by shared q-grams")
                by_q.setdefault(own, []).append((_codes(text), need, group))
        ids = [x for x, _ in items]
        return cls([_Index.build(own, ps, max_edits) for own, ps in sorted(by_q.items())], [[ids[n] for n in s] for s in sets])


def _expand(index: _Index, at: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document position, passage, passage position) of every posting of the hit q-grams."""
    first, n = index.start[hits], index.start[hits + 1] - index.start[hits]
    where = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return np.repeat(at, n), index.passage[where], index.pos[where]


def _regions(index: _Index, doc: np.ndarray, where: np.ndarray, passage: np.ndarray, pos: np.ndarray, docs: int, step: int) -> np.ndarray:
    """(document, passage, lowest diagonal, first, last position): parts of bands with as many hits as a window must share.

    Hits of a band further apart than any window of the passage belong to different parts.
    """
    none = np.empty((0, 5), np.int64)
    n = len(index.texts)
    unit = doc * n + passage
    many = (np.bincount(unit, minlength=docs * n).reshape(docs, n) >= index.bound).ravel()[unit]
    unit, where, pos = unit[many], where[many], pos[many]
    if not len(pos):
        return none
    band = (where - pos) // step
    low = int(band.min()) - 1
    # Diagonal x lies in the bands that begin at its own step and at the one before.
    span = int(band.max()) - low + 2
    key = unit * span + (band - low)
    # Most hits are alone in their band: coarse counts, a band and its neighbours together, drop them before the sort.
    slots = np.bincount(key & 0xFFFFF, minlength=1 << 20)
    near = slots + np.roll(slots, 1) + np.roll(slots, -1)
    some = near[key & 0xFFFFF] >= index.bound[unit % n]
    key, pos = key[some], pos[some]
    if not len(pos):
        return none
    wide = int(pos.max()) + 1
    both = np.sort(np.concatenate((key * wide + pos, (key - 1) * wide + pos)))
    keys, at = both // wide, both % wide
    owner = keys // span % n
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] - at[:-1] > index.longest[owner[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    enough = last - first + 1 >= index.bound[owner[first]]
    first, last = first[enough], last[enough]
    own = owner[first]
    return np.stack((keys[first] // span // n, own, (keys[first] % span + low) * step, at[first] - index.longest[own], at[last] + index.longest[own] + index.q), axis=1)


def _align(index: _Index, joined: np.ndarray, cands: np.ndarray, width: int, max_edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, item set, edits) of every window found.

    A candidate is (document's begin in ``joined``, its length, passage, lowest diagonal of the band,
    first and last passage position). reach[k][c, d]: how much of the passage, ending at the current
    position on diagonal d of candidate c's band, is covered by the document with k edits. All candidates
    advance together from their own first positions.
    """
    begin, size, low = cands[:, 0:1], cands[:, 1:2], cands[:, 3:4]
    lengths = np.array([len(index.texts[i]) for i in cands[:, 2]])
    from_ = np.maximum(cands[:, 4], 0)
    to = np.minimum(cands[:, 5], lengths)
    longest = int((to - from_).max())
    text = np.zeros((len(cands), longest), np.uint32)
    need = np.full((len(cands), longest), _FAR, np.int64)
    group = np.zeros((len(cands), longest), np.int64)
    for c, (i, a, b) in enumerate(zip(cands[:, 2].tolist(), from_.tolist(), to.tolist())):
        text[c, : b - a] = index.texts[i][a:b]
        need[c, : b - a] = index.need[i][a + 1 : b + 1]
        group[c, : b - a] = index.group[i][a + 1 : b + 1]
    diagonals = low + np.arange(width)[None, :] + from_[:, None]
    none = np.int64(-(1 << 20))
    edge = np.full((len(cands), 1), none)
    last = [np.zeros((len(cands), width), np.int64) for _ in range(max_edits + 1)]
    ends = (need < _FAR).any(axis=0)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for p in range(longest):
        j = p + diagonals
        inside = (j >= 0) & (j < size)
        same = inside & (joined[np.where(inside, begin + j, 0)] == text[:, p : p + 1])
        now: list[np.ndarray] = []
        open_ = np.ones(len(cands), bool)
        for k in range(max_edits + 1):
            reach = np.where(same, last[k] + 1, none if k else 0)
            if k:
                dropped = np.concatenate((last[k - 1][:, 1:], edge), axis=1) + 1
                extra = np.concatenate((edge, now[k - 1][:, :-1]), axis=1)
                reach = np.maximum(np.maximum(reach, last[k - 1] + 1), np.maximum(dropped, extra))
            now.append(reach)
            if ends[p]:
                done = np.flatnonzero((reach.max(axis=1) >= need[:, p]) & open_)
                open_[done] = False  # fewer edits have found it
                if len(done):
                    got.append((done, group[done, p], np.full(len(done), k)))
        last = now
    if not got:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*got))


def _search(block: _Block, docs: list[np.ndarray], max_edits: int) -> dict[tuple[int, int], int]:
    """(document, item set) -> least edits, of one slice of documents."""
    sizes = np.array([len(d) for d in docs], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = np.zeros(int(begin[-1]), np.uint32)  # a zero follows every document and is in no item
    for d, b in zip(docs, begin):
        joined[b : b + len(d)] = d
    step = max_edits + 1
    best: dict[tuple[int, int], int] = {}
    for index in block.indexes:
        h = _gram_hashes(joined, index.q)
        at = np.flatnonzero(index.bits[(h >> np.uint64(44)).astype(np.int64)])
        found = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
        hit = index.grams[found] == h[at]
        at, found = at[hit], found[hit]
        of = np.searchsorted(begin, at, side="right") - 1
        enough = (np.bincount(of, minlength=len(docs)) >= index.bound.min())[of]
        at, found, of = at[enough], found[enough], of[enough]
        cands = []
        together = max(1, CELLS // len(index.texts))  # documents counted at once
        for lo in range(0, len(docs), together):
            mine = slice(*np.searchsorted(of, [lo, lo + together]))
            if mine.start == mine.stop:
                continue
            n = index.start[found[mine] + 1] - index.start[found[mine]]
            doc = np.repeat(of[mine] - lo, n)
            kept = _regions(index, doc, *_expand(index, at[mine] - begin[of[mine]], found[mine]), min(together, len(docs) - lo), step)
            kept[:, 0] += lo
            cands.append(kept)
        every = np.concatenate(cands) if cands else np.empty((0, 5), np.int64)
        every = every[np.argsort(every[:, 4] - every[:, 3], kind="stable")]  # regions of like length together
        lo = 0
        while lo < len(every):
            hi = lo + 1
            while hi < len(every) and (hi + 1 - lo) * int(every[hi, 4] - every[hi, 3]) <= CELLS:
                hi += 1
            some = every[lo:hi]
            cand, group, edits = _align(index, joined, np.column_stack((begin[some[:, 0]], sizes[some[:, 0]], some[:, 1:])), 2 * step, max_edits)
            rows = np.unique(np.stack((some[cand, 0], group, edits), axis=1), axis=0)[::-1]  # fewest edits last
            best |= {(d, g): e if (d, g) not in best else min(e, best[d, g]) for d, g, e in rows.tolist()}
            lo = hi
    return best


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str,
    doc_text: str,
    item_id: str,
    item_text: str,
    *,
    min_words: int = 12,
    max_edits: int = 1,
    q: int = 12,
    block_chars: int = 2_000_000,
    slice_chars: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold a window of ``min_words`` words of an item.

    edits is the least number of inserted, deleted or replaced characters over all windows, 0 for
    words that are all equal. ``q`` is the longest q-gram; items whose windows are too short for it and
    ``max_edits`` take a shorter one, and ValueError is raised where even q-grams of 2 could miss a window.
    Null and empty texts, and items of fewer than ``min_words`` words, match nothing. Repeated documents
    or items give one row per pair of ids. Empty tables give no rows. Whole texts are read, however long.
    The items are read, one block at a time, while the result is being planned.
    """
    if q < 2 or min_words < 1 or max_edits < 0:
        raise ValueError("q must be at least 2, min_words at least 1, max_edits at least 0")
    kind_d, kind_i = documents.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = T.StructType([T.StructField("d", kind_d), T.StructField("i", kind_i), T.StructField("edits", T.IntegerType())])
    slim = documents.select(F.col(doc_id).alias("d"), F.col(doc_text).cast("string").alias("text")).filter("text is not null and text <> ''")
    sc = documents.sparkSession.sparkContext
    arrow = list(to_arrow_schema(schema))
    sql = caseless_sql(look_alikes(documents.sparkSession))

    def blocks() -> Iterator[_Block]:
        con, block, size = connect(), [], 0
        make = lambda: _Block.build(list(zip([r[0] for r in block], _words(con, [r[1] for r in block], sql))), min_words, max_edits, q)
        wanted = items.select(F.col(item_id), F.col(item_text).cast("string")).filter(F.col(item_text).isNotNull()).distinct()
        for row in wanted.toLocalIterator():
            if block and size + len(row[1]) > block_chars:
                if (made := make()) is not None:
                    yield made
                block, size = [], 0
            block.append(row)
            size += len(row[1])
        if block and (made := make()) is not None:
            yield made

    def passes(shared, ready: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con, block = None if ready else connect(), shared.value
            overlap = max(int(x.longest.max()) for x in block.indexes) + max_edits + 1
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [_codes(t) for t in texts] if ready else [_spaced(t) for t in mapped(con, texts, sql)]
                # A long text goes in stretches that overlap by more than any window, so none is lost between them.
                parts = [(n, c[lo : lo + slice_chars + overlap]) for n, c in enumerate(found) for lo in range(0, max(len(c) - overlap, 1), slice_chars)]
                lo = 0
                while lo < len(parts):
                    hi, size = lo, 0
                    while hi < len(parts) and (hi == lo or size + len(parts[hi][1]) <= slice_chars):
                        size += len(parts[hi][1])
                        hi += 1
                    got = [(parts[lo + d][0], i, e) for (d, g), e in _search(block, [c for _, c in parts[lo:hi]], max_edits).items() for i in block.sets[g]]
                    if got:
                        columns = [[ids[d] for d, _, _ in got], [i for _, i, _ in got], [e for _, _, e in got]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=["d", "i", "edits"])
                    lo = hi

        return run

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_words(con, batch.column(1).to_pylist(), sql), pa.string())], names=["d", "text"])

    out, source, held = None, slim, None
    for block in blocks():
        if held is not None and source is slim:
            # A second block: from here on the words are read, not made anew.
            source = materialise(slim.mapInArrow(words, slim.schema).filter("text <> ''"))
        if held is not None:
            part = source.mapInArrow(passes(sc.broadcast(held), True), schema)
            out = part if out is None else out.unionByName(part)
        held = block
    if held is not None:
        part = source.mapInArrow(passes(sc.broadcast(held), source is not slim), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], schema)
    best = out.groupBy("d", "i").agg(F.min("edits").alias("edits"))
    return best.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "edits")
