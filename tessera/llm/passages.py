"""Substring dedup: passages of at least ``words`` words that are equal or near-duplicates of passages of other documents.

1. Shingles of five words take the place of tokens. Their Cartesian tree under a hash gives compact windows (l, c, r): all runs within l..r that hold c
   have their least hash at c, so one row stands for all of them. Long stretches of one repeated word are taken apart: a passage within them is one row.
2. How many hash functions are enough: one. A passage at the threshold that edits have broken still has an equal run of ``seed`` shingles (pigeonhole; 21 for
   50 words at 80 %: one edit in 46 shingles), whose least place is the centre of a window in both documents. That run reaches ``context`` places to the left or
   to the right of the centre, so the two meet in the group of (centre, left context) or of (centre, right context). A group that lies within another is left out.
3. Windows of a group with the same surroundings (``sight`` places to either side) are one class, for which one of them stands: copies are counted, never paired.
4. Classes of a group are joined as intervals around the centre. Equal runs of the least length: every run through the centre is hashed, equal hashes are one
   cluster around its smallest document; linear, no leader, nothing lost. Near-duplicates: equal runs of ``seed`` around the centre, carried on over edits, at
   ``percent`` or more of the union. All pairs of a group are compared. Those of more than ``SMALL`` classes leave out only what can't change a result: classes
   that have fewer places in common with other documents than verification asks for, and pairs that are linked already and have nothing left to share that
   smaller documents didn't give them. Variants of one template so take linear time; at worst it is quadratic in the group's classes.
5. A group of more than ``BLOCK`` classes is cut into blocks, and every two blocks meet in a task of their own.
6. Members take over their class's passages; links give components by distributed star contraction.
7. Disk: sequences are kept of what is seen from shared centres only; tables and shuffle files that nothing reads any more are deleted between the steps.

What is certain: every run of ``words`` equal words of two documents is in the spans of both, and they share a component. (Places are compared by 32 bits of their
hashes.) Groups of any size give what comparing all their pairs gives. A near passage begins and ends with equal shingles and is looked for within
``sight`` places of a centre, which hold any two runs with one edit between; those near enough just with two edits on one side of each centre can be missed.

Result: a row for every document that shares a passage, none for others: doc_id, n_passages, dup_words, spans (start:end in words, end exclusive,
comma-joined), cut_spans (those parts that a document of smaller id has: what deduplication removes), component_id (smallest doc_id reachable by shared passages).

Defined cases: null or short texts share nothing; a null id shares nothing; rows that repeat an id are not compared with each other; an empty table
gives an empty result; other columns are not read; very long texts are read whole, in time linear in their length, also where one word is repeated throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import map_arrow, mix64, shingles, spent, written

WIDTH, WORDS, BATCH, BLOCK, SMALL, PAIRS, LONG = 5, 50, 512, 4096, 32, 20_000, 64
AT_ONCE = 3000  # pairs whose views and what is made of them stay near the processor
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_NONE = 0xFFFFFFFF


@dataclass(frozen=True)
class Shape:
    """What a passage is, in shingles."""

    words: int = WORDS
    percent: int = 80
    width: int = WIDTH

    def __post_init__(self) -> None:
        if not 1 <= self.width <= self.words or not 0 < self.percent <= 100:
            raise ValueError("1 <= width <= words and 0 < percent <= 100 are needed")

    @property
    def least(self) -> int:
        return self.words - self.width + 1

    @property
    def need(self) -> int:
        """Equal shingles that a near passage of the least length has."""
        return -(-2 * self.percent * self.least // (100 + self.percent))

    @property
    def seed(self) -> int:
        """The longest equal run of any near passage has at least so many shingles, whatever the number of single edits."""
        best, rest = self.least, 100 - self.percent
        for edits in range(1, self.least // self.width + 2) if rest else ():
            size = max(self.least, -(-edits * self.width * (100 + self.percent) // rest))
            best = min(best, -(-(size - self.width * edits) // (edits + 1)))
        return max(1, best)

    @property
    def context(self) -> int:
        return self.seed // 2

    @property
    def reach(self) -> int:
        return self.least - 1

    @property
    def edits(self) -> int:
        """Edits that a passage of the least length may have."""
        return max(1, self.least * (100 - self.percent) // (self.width * (100 + self.percent)))

    @property
    def gap(self) -> int:
        """Shingles that an edit between two runs shorter than ``least`` may break on both sides together, if the whole is to be near enough."""
        return 2 * self.reach * (100 - self.percent) // self.percent

    @property
    def sight(self) -> int:
        """How far from a centre at one end of such a whole its other end may be."""
        return max(self.reach, 2 * self.reach - 1 + self.gap)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column's values, one after the other, and the places before, between and after them. Null: none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (as ``split_words`` has them), one after the other, equal in every process; and where each text's words end. All words
    are hashed at once, eight bytes at a time; those of more than ``LONG`` bytes one by one."""
    import xxhash

    raw, edges = _bytes(texts)
    n = len(raw)
    text = np.zeros(n + 8, np.uint8)
    text[:n] = raw + ((raw - np.uint8(65) < 26).view(np.uint8) << 5)
    edge, blank = np.zeros(n + 1, bool), np.ones(n + 2, bool)
    edge[edges] = True
    blank[1:-1] = (raw == 32) | (raw - np.uint8(9) < 5)
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
    size = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1 - starts
    eight = np.ndarray(n + 1, "<u8", text, strides=(1,))
    mask = np.append(np.uint64(0), ~np.uint64(0) >> np.arange(56, -1, -8).astype(np.uint64))
    h = mix64(mix64(size.astype(np.uint64)) ^ (eight[starts] & mask[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    for at in range(8, LONG, 8):
        if not len(more := more[size[more] > at]):
            break
        h[more] = mix64(h[more] * _BASE + (eight[starts[more] + at] & mask[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + size[i]].tobytes())
    return h, np.searchsorted(starts, edges[1:])


def sequences(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit shingle hashes of all texts, one text after the other, and where those of each end; none of a text of fewer words."""
    hashes, to = word_hashes(texts)
    sizes = np.maximum(np.diff(to, prepend=0) - width + 1, 0)
    first = np.arange(max(0, len(hashes) - width + 1))
    whole = first + width <= to[np.repeat(np.arange(len(to)), np.diff(to, prepend=0))[: len(first)]]
    return shingles(hashes, width)[: len(first)][whole], np.cumsum(sizes)


def compact_windows(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), r inclusive, of the compact windows of at least ``seed`` places within the segments: all runs of ``seed`` places within l..r that hold c have
    their centre there; l and r are followed less than ``seed`` places from c.

    s: 32-bit shingle hashes of all segments, one after the other. The nodes of the Cartesian tree whose window is long enough are the leftmost minima of runs
    of ``seed`` places: a sliding minimum finds them in linear time, whatever the tree's depth. Where the least place begins a stretch of equal places that the
    run cuts off on the left, the stretch's end is the centre: a repeated word gives two centres, not one for each place; within it there is none."""
    n, none = len(s), np.zeros(0, np.int64)
    if n < seed:
        return none, none, none
    h = (mix64(s.astype(np.uint64) + np.uint64(0x51)) >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    low, w = h, 1
    while 2 * w <= seed:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    low = np.minimum(low[: n - seed + 1], low[seed - w : n - w + 1])
    own = np.repeat(np.arange(len(starts)), ends - starts)
    i = np.flatnonzero(own[: n - seed + 1] == own[seed - 1 :])
    first = (low[i] & _LOW).astype(np.int64)
    last = _stretches(s, own)
    last = np.repeat(last, np.diff(last, prepend=-1))[first]
    keep = (first > i) | (last < i + seed - 1)
    i, c = i[keep], np.where(first > i, first, last)[keep]
    order = np.argsort(c, kind="stable")
    i, c = i[order], c[order]
    at = np.flatnonzero(np.diff(c, prepend=-1))
    return i[at], c[at], i[np.append(at[1:], len(c)) - 1] + seed - 1 if len(c) else none


def _stretches(s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The last places of all stretches of equal places."""
    return np.flatnonzero(np.append((s[1:] != s[:-1]) | (own[1:] != own[:-1]), True))


def _constant(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of stretches of at least so many equal places: passages of one word."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = _stretches(s, np.repeat(np.arange(len(starts)), ends - starts))
    first = np.append(0, last[:-1] + 1)
    ok = last - first + 1 >= least
    return first[ok], last[ok]


def _blanked(s: np.ndarray, ends: np.ndarray, c: np.ndarray, p: Shape) -> np.ndarray:
    """s, with what nothing looks at (all but what is seen from the centres c of its segments, and stretches of equal places) as 0, 1, 0, 1 ..., which takes no room."""
    starts = np.append(0, ends[:-1])
    first, last = _constant(s, starts, ends, p.least)
    from_, to = np.concatenate([c - p.sight - p.seed, first - 1]), np.concatenate([c + p.sight + p.seed, last + 1])
    deep = np.bincount(np.maximum(from_, 0), minlength=len(s) + 1) - np.bincount(np.minimum(to + 1, len(s)), minlength=len(s) + 1)
    return np.where(np.cumsum(deep)[:-1] > 0, s, (np.arange(len(s)) & 1).astype(np.uint32))


class _Runs:
    """Hashes of runs of a sequence: a polynomial modulo 2**64 in an odd, hence invertible, base."""

    def __init__(self, s: np.ndarray):
        powers = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(s), b, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s.astype(np.uint64) + np.uint64(1)) * powers(_BASE)[: len(s)], dtype=np.uint64)])
        self.inverse = powers(np.uint64(pow(int(_BASE), -1, 1 << 64)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _windows(docs: DataFrame, p: Shape) -> DataFrame:
    """value (hash of the centre's shingle), doc, at (the centre)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        s, ends = sequences(batch.column(1), p.width)
        sizes = np.diff(ends, prepend=0)
        if not len(sizes) or sizes.max() < p.seed:
            return None
        short = (s >> np.uint64(32)).astype(np.uint32)
        _, c, _ = compact_windows(short, ends - sizes, ends, p.seed)
        again, _ = _constant(short, ends - sizes, ends, p.least)
        value = np.concatenate([s[c], ~s[again]])
        c = np.concatenate([c, again])
        own = np.searchsorted(ends, c, side="right")
        ids = batch.column(0).to_numpy(zero_copy_only=False)[own]
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids), pa.array((c - (ends - sizes)[own]).astype(np.int32))], names=["value", "doc", "at"])

    return map_arrow(docs.select("doc_id", "text"), one, "value long, doc long, at int", rows=BATCH)


def _joined(batch: pa.RecordBatch, seq: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's sequences, one after the other, with their starts and ends."""
    s, at = _bytes(batch.column(seq))
    return s.view(np.uint32), at[:-1] // 4, at[1:] // 4


def _surroundings(runs: _Runs, c: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of what lies within ``reach`` of each c, and how far it goes to the left and right. last: exclusive."""
    a, b = np.maximum(c - reach, first), np.minimum(c + reach + 1, last)
    return mix64(runs(a, b) ^ mix64(((c - a).astype(np.uint64) << np.uint64(32)) + (b - c).astype(np.uint64))), c - a, b - 1 - c


def _members(seqs: DataFrame, p: Shape) -> DataFrame:
    """key (centre and one context), other (centre and right context, if key has the left one and there are both), same (its surroundings), doc, at, left, right: a row
    for each window; with left = -1 one for each stretch of one word."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        s, starts, ends = _joined(batch, "seq")
        l, c, r = compact_windows(s, starts, ends, p.seed)
        again, last = _constant(s, starts, ends, p.least)
        lists = batch.column("at")
        own = np.repeat(np.arange(len(ends)), np.diff(lists.offsets.to_numpy()))
        wanted = starts[own] + lists.flatten().to_numpy()
        keep = np.isin(c, wanted[wanted < ends[own]])  # of rows that repeat an id each has just its own
        l, c, r = l[keep], c[keep], r[keep]
        own = np.searchsorted(ends, c, side="right")
        runs = _Runs(s)
        same, left, right = _surroundings(runs, c, starts[own], ends[own], p.sight)
        # a window of seed places reaches context places at least to one side
        before, after = c - l >= p.context, (r - c >= p.context) & (p.context > 0)
        by_left, by_right = mix64(runs(np.maximum(c - p.context, 0), c + 1) ^ np.uint64(11)), mix64(runs(c, np.minimum(c + p.context + 1, len(s))) ^ np.uint64(77))
        word, owner = mix64(s[again].astype(np.uint64) ^ np.uint64(0xC0 << 32)), np.searchsorted(ends, again, side="right")
        own, place = np.concatenate([own, owner]), np.concatenate([c, again])
        other = pa.array(np.concatenate([by_right, word]).view(np.int64), mask=np.concatenate([~(before & after), np.full(len(again), True)]))
        key, same = (np.concatenate([x, word]).view(np.int64) for x in (np.where(before, by_left, by_right), same))
        sizes = (np.concatenate([left, np.full(len(again), -1)]).astype(np.int32), np.concatenate([right, last - again]).astype(np.int32))
        columns = (key, other, same, batch.column("doc").to_numpy()[own], (place - starts[own]).astype(np.int32), *sizes)
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["key", "other", "same", "doc", "at", "left", "right"])

    return map_arrow(seqs, one, "key long, other long, same long, doc long, at int, left int, right int", rows=BATCH)


def _groups(sides: DataFrame) -> DataFrame:
    """group, n (its classes): groups of several documents. A group whose classes all lie in one other group too is left out: there the same pairs meet. Of two equal
    ones that of the smaller number stays; a group that covers another is covered by none but an equal one."""
    each = sides.groupBy("group").agg(F.count("*").alias("n"), F.min("lo").alias("a"), F.max("hi").alias("b"), F.count("beside").alias("k"), F.min("beside").alias("first"), F.max("beside").alias("last"))
    each = written(each.where("n > 1 AND a <> b").select("group", "n", F.expr("CASE WHEN k = n AND first = last THEN first END").alias("within")), "groups")
    wider = each.where("within IS NOT NULL").join(each.select(F.col("group").alias("within"), F.col("n").alias("wide")).hint("shuffle_hash"), "within")
    covered = wider.where("n < wide OR (n = wide AND group > within)").select("group")
    return each.select("group", "n").join(covered.hint("shuffle_hash"), "group", "left_anti")


def _views(reps: DataFrame, p: Shape) -> DataFrame:
    """The places around each centre, 32 bits each."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        s, starts, ends = _joined(batch, "seq")
        m = batch.column("m")
        own, each = np.repeat(np.arange(batch.num_rows), np.diff(m.offsets.to_numpy())), m.flatten()
        c = starts[own] + each.field("at").to_numpy()
        there = np.flatnonzero(c < ends[own])
        same, _, _ = _surroundings(_Runs(s), c[there], starts[own[there]], ends[own[there]], p.sight)
        there = there[same.view(np.int64) == each.field("same").to_numpy()[there]]
        if not len(there):
            return None
        place = c[there, None] + np.arange(-p.sight, p.sight + 1)
        out = np.minimum(s[np.clip(place, 0, len(s) - 1)], np.uint32(_NONE - 1))
        out[(place < starts[own[there], None]) | (place >= ends[own[there], None])] = _NONE
        size = out.itemsize * (2 * p.sight + 1)
        view = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((np.arange(len(there) + 1) * size).astype(np.int32)), pa.py_buffer(out.tobytes())])
        take = pa.array(there)
        return pa.RecordBatch.from_arrays([*(each.field(n).take(take) for n in ("group", "key", "same", "lo", "hi", "blocks")), view], names=["group", "key", "same", "lo", "hi", "blocks", "view"])

    return map_arrow(reps, one, "group long, key long, same long, lo long, hi long, blocks int, view binary", rows=BATCH)


def _first_false(x: np.ndarray) -> np.ndarray:
    """By row, how many are true from the first on."""
    return np.where(x.all(axis=1), x.shape[1], x.argmin(axis=1))


def _resync(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, p: Shape) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By row what an edit breaks in a from i and in b from j, and for how long they are equal after it: for the edit after which that is longest, and for the one
    that leaves most of the passage's edits to others. The last column is empty."""
    n, end = a.shape[0], a.shape[1] - 1
    width = np.arange(min(p.gap + 1, end))
    u, v = (np.take_along_axis(x, np.minimum(at[:, None] + width, end), axis=1) for x, at in ((a, i), (b, j)))
    some = np.flatnonzero(_common(u, v))
    u, v = u[some], v[some]
    equal = (u[:, :, None] == v[:, None, :]) & (u != _NONE)[:, :, None]
    start = equal & (width[:, None] + width <= p.gap)
    start[:, 1:, 1:] &= ~equal[:, :-1, :-1]  # a later start of the same run breaks more and gives less
    row, x, y = np.unravel_index(np.flatnonzero(start), start.shape)
    row, length = some[row], np.zeros(len(row), np.int64)
    offsets = np.arange(end - min(int((i[row] + x).min()), int((j[row] + y).min())) if len(row) else 0)  # none is equal beyond the end
    for at in range(0, len(row), PAIRS):
        of = slice(at, at + PAIRS)
        u, v = (z[row[of, None], np.minimum((k[row[of]] + g[of])[:, None] + offsets, end)] for z, k, g in ((a, i, x), (b, j, y)))
        length[of] = _first_false((u == v) & (u != _NONE))
    out = []
    for score in (length, (100 - p.percent) * length - p.percent * (x + y)):
        order = np.lexsort((-x - y, score, row))
        last = order[np.append(np.diff(row[order]) != 0, True)] if len(row) else order
        best = [np.zeros(n, np.int64) for _ in range(3)]
        for z, of in zip(best, (x, y, length), strict=True):
            z[row[last]] = of[last]
        out.append(tuple(best))
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row at least as many places as a and b can have equal, whatever is put in or taken out."""
    both = np.sort(np.hstack([a, b]), axis=1)
    return np.count_nonzero((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE), axis=1)


def near_passages(a: np.ndarray, b: np.ndarray, p: Shape) -> tuple[np.ndarray, ...]:
    """For views in pairs: 1 where there are near passages through the centre (2: just an equal one), and their first and last place in a and in b, from the centre."""
    reach = a.shape[1] // 2
    empty = np.full((len(a), 1), _NONE, np.uint32)
    kind, sa, ea, sb, eb = (np.zeros(len(a), np.int64) for _ in range(5))
    e = (a == b) & (a != _NONE)
    right, left = _first_false(e[:, reach :]), _first_false(e[:, reach - 1 :: -1]) if reach else np.zeros(len(a), np.int64)
    k = np.flatnonzero((right > 0) & (left + right >= p.seed))
    # what may follow an edit on either side is at most what the two have in common there
    few = left[k] + right[k] < p.need
    if few.any():
        i = k[few]
        more = _common(a[i, reach + 1 :], b[i, reach + 1 :]) - (right[i] - 1) + _common(a[i, : reach], b[i, : reach]) - left[i]
        few[few] = left[i] + right[i] + more < p.need
        k = k[~few]
    if not len(k):
        return kind, sa, ea, sb, eb
    left, right = left[k], right[k]
    sides = []
    for x, y, i in ((a[k], b[k], reach + right), (a[k][:, ::-1], b[k][:, ::-1], reach + 1 + left)):
        x, y = np.hstack([x, empty[k]]), np.hstack([y, empty[k]])
        options, zero = [], np.zeros(len(k), np.int64)
        first = _resync(x, y, i, i, p)
        for which, (ga, gb, n) in enumerate(first):
            u, v, equal = np.where(n > 0, i + ga + n, i), np.where(n > 0, i + gb + n, i), n
            for _ in range(p.edits - 1):
                ga, gb, n = _resync(x, y, u, v, p)[which]
                u, v, equal = np.where(n > 0, u + ga + n, u), np.where(n > 0, v + gb + n, v), equal + n
            options.append((u - i, v - i, equal))
        sides.append([(zero, zero, zero), *options])
    run = left + right
    for (ru, rv, rn), (lu, lv, ln) in product(*sides):
        equal, size_a, size_b = run + rn + ln, run + ru + lu, run + rv + lv
        ok = (np.minimum(size_a, size_b) >= p.least) & (equal * 100 >= p.percent * (size_a + size_b - equal))
        at = k[ok]
        kind[at] = np.where((equal > run)[ok], 1, np.where(kind[at], kind[at], 2))
        sa[at], ea[at] = np.minimum(sa[at], -(left + lu)[ok]), np.maximum(ea[at], (right + ru - 1)[ok])
        sb[at], eb[at] = np.minimum(sb[at], -(left + lv)[ok]), np.maximum(eb[at], (right + rv - 1)[ok])
    return kind, sa, ea, sb, eb


def _shared_runs(view: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """row, first place and smallest document of the runs of that length through the centre that several documents of a group have."""
    view = view[:, reach - length + 1 : reach + length]
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(view.shape[1], _BASE, np.uint64)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(view.shape[1], pow(int(_BASE), -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    zero = np.zeros((len(view), 1), np.uint64)
    sums = np.hstack([zero, np.cumsum(mix64(view.astype(np.uint64) + np.uint64(1)) * powers[:-1], axis=1, dtype=np.uint64)])
    gone = np.hstack([zero.astype(np.int32), np.cumsum(view == _NONE, axis=1, dtype=np.int32)])
    whole = gone[:, length:] == gone[:, :-length]
    h = mix64(((sums[:, length:] - sums[:, :-length]) * inverse[:length]) ^ mix64(group.astype(np.uint64))[:, None])
    row, place = np.nonzero(whole)
    flat = h[row, place]
    order = np.argsort(flat)
    new = np.diff(flat[order], prepend=~flat[order[:1]]) != 0
    first, which = np.flatnonzero(new), np.empty(len(flat), np.int64)
    which[order] = np.cumsum(new) - 1
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    least, most = np.minimum.reduceat(lo[row[order]], first), np.maximum.reduceat(hi[row[order]], first)
    good = np.flatnonzero((least != most)[which])
    return row[good], place[good], least[which[good]]


def _equal_runs(view: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: Shape) -> tuple[np.ndarray, ...]:
    """row, first and last place from the centre, and the smallest document, of runs of the least length through the centre that several documents have."""
    row, place, m = _shared_runs(view, group, lo, hi, p.least, view.shape[1] // 2)
    start = (np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-9) != 1) | (np.diff(m, prepend=m[:1]) != 0)
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(row)) - 1 if len(at) else at
    return row[at], place[at] - p.reach, place[end] - p.reach + p.least - 1, m[at]


def _shared_places(view: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each row of one group, which places hold a shingle that another document has too: a near passage has no other equal ones, and ends at such."""
    known, which = np.unique(view, return_inverse=True)
    which = which.ravel()
    least, most = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(least, which, np.repeat(lo, view.shape[1]))
    np.maximum.at(most, which, np.repeat(hi, view.shape[1]))
    return ((least != most) & (known != _NONE))[which].reshape(view.shape)


def _widening(row: np.ndarray, s: np.ndarray, e: np.ndarray, m: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Spans (row, s, e, m) by row and m, those of one partner as one, and whether partners of smaller m leave any of it out."""
    order = np.lexsort((m, row))
    row, s, e, m = row[order], s[order], e[order], m[order]
    at = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(m, prepend=m[:1]) != 0))
    if len(at):
        row, m, s, e = row[at], m[at], np.minimum.reduceat(s, at), np.maximum.reduceat(e, at)
    most = np.stack([np.maximum.accumulate(row * span - s), np.maximum.accumulate(row * span + e)])
    return row, s, e, m, (np.diff(row, prepend=-1) != 0) | (np.diff(most, prepend=-1, axis=1) > 0).any(axis=0)


class _Sets:
    """Numbers from 0 to n - 1 in sets that are united pair by pair."""

    def __init__(self, n: int):
        self.up, self.set = list(range(n)), np.arange(n)

    def _find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def unite(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs have united two sets."""
        apart = np.flatnonzero(self.set[a] != self.set[b])
        _, first = np.unique(self.set[a[apart]] * len(self.up) + self.set[b[apart]], return_index=True)
        united = []
        for at in apart[first].tolist():
            x, y = self._find(int(a[at])), self._find(int(b[at]))
            if x != y:
                self.up[x] = y
                united.append(at)
        if united:
            self.set = np.array([self._find(x) for x in range(len(self.up))])
        return np.array(united, np.int64)


def _large_group(view: np.ndarray, lo: np.ndarray, hi: np.ndarray, equal: tuple[np.ndarray, ...], p: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans (row, s, e, m) of the near passages of all pairs of rows of one group; equal: those of its equal runs. What changes nothing is left out: a span that
    partners of smaller documents cover, unless it links what nothing else has linked; so a pair is not compared if the two are linked and both have,
    with documents no larger than the pair's smaller, all that they could share with any."""
    mine = np.arange(len(view))
    while True:  # rows that share too little with all others go; then others may share too little
        places = _shared_places(view[mine], lo[mine], hi[mine])
        enough = places.sum(axis=1) >= p.need
        mine, places = mine[enough], places[enough]
        if enough.all() or not len(mine):
            break
    order = np.argsort(lo[mine], kind="stable")
    mine, places, n = mine[order], places[order], len(mine)
    view, lo, hi = view[mine], lo[mine], hi[mine]
    if n < 2:
        return
    middle = view.shape[1] // 2
    first, last = places.argmax(axis=1) - middle, middle - places[:, ::-1].argmax(axis=1)
    docs, doc = np.unique(lo, return_inverse=True)
    sets, own = _Sets(len(docs)), np.full(mine.max() + 1, -1)
    own[mine] = np.arange(n)
    order = np.argsort(equal[3], kind="stable")
    row, s, e, m = own[equal[0][order]], *(x[order] for x in equal[1:])
    sets.unite(doc[row], np.searchsorted(docs, m))
    low, high, done, step = np.full(n, p.words), np.full(n, -p.words), 0, max(1, PAIRS // n)
    for start in range(0, n, step):
        lead, to = np.arange(start, min(n, start + step)), np.searchsorted(m, lo[start], side="right")
        np.minimum.at(low, row[done:to], s[done:to])
        np.maximum.at(high, row[done:to], e[done:to])
        done, full = to, (low <= first) & (high >= last)
        known = (full[lead, None] & full[start:]) & (sets.set[doc[lead], None] == sets.set[doc[start:]])
        i, j = np.nonzero((lead[:, None] < np.arange(start, n)) & ~known)
        i, j = i + start, j + start
        several = (lo[i] != lo[j]) | (hi[i] != lo[i]) | (hi[j] != lo[j])
        i, j = i[several], j[several]
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            kind, sa, ea, sb, eb = near_passages(view[a], view[b], p)
            k = np.flatnonzero(kind == 1)  # equal runs are there already
            a, b, sa, ea, sb, eb = (x[k] for x in (a, b, sa, ea, sb, eb))
            k = sets.unite(doc[a], doc[b])
            yield mine[a[k]], sa[k], ea[k], lo[b[k]]
            r, u, v, other = np.concatenate([a, b]), np.concatenate([sa, sb]), np.concatenate([ea, eb]), np.concatenate([lo[b], lo[a]])
            wide = (u < low[r]) | (v > high[r])
            r, u, v, other, keep = _widening(r[wide], u[wide], v[wide], other[wide], view.shape[1])
            yield mine[r[keep]], u[keep], v[keep], other[keep]
            later = b > lead[-1]  # all that these have met so far are of documents no larger than the next lead
            np.minimum.at(low, b[later], sb[later])
            np.maximum.at(high, b[later], eb[later])


def _pairs_of(size: np.ndarray, at: np.ndarray, small: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the small groups. size, at: of each row's group, and the row's place in it."""
    for d in range(1, SMALL):
        if len(i := np.flatnonzero(small & (at + d < size))):
            yield i, i + d


def _meet(p: Shape):
    """Spans (key, same, s, e, m) of classes that share a passage with another of their group; s and e from the centre, e inclusive; m the partner's smallest document;
    lo the class's. All spans hold the centre, so those of one partner are one; ``keep`` is false where partners of smaller m have all of it: it is a link only."""

    def work(t: pa.Table) -> pa.RecordBatch:
        g, lo, hi = (t.column(c).to_numpy() for c in ("g", "lo", "hi"))
        size, view = len(t.column("view")[0].as_py()), b"".join(t.column("view").to_pylist())
        view = np.frombuffer(view, np.uint32 if size == 4 * (2 * p.sight + 1) else np.uint16).astype(np.uint32, copy=False).reshape(len(g), -1)
        new = np.diff(g, prepend=~g[:1]) != 0
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(first, len(g)))
        out = [_equal_runs(view, group, lo, hi, p)]

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            one = (lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j])
            kind, sa, ea, sb, eb = near_passages(view[i], view[j], p)
            k = np.flatnonzero((kind == 1) & ~one)  # equal runs are there already
            out.extend([(i[k], sa[k], ea[k], lo[j[k]]), (j[k], sb[k], eb[k], lo[i[k]])])

        for i, j in _pairs_of(size[group], np.arange(len(g)) - first[group], size[group] <= SMALL):
            for at in range(0, len(i), AT_ONCE):
                compare(i[at : at + AT_ONCE], j[at : at + AT_ONCE])
        row = out[0][0]
        for k in np.flatnonzero(size > SMALL):
            of = slice(first[k], first[k] + size[k])
            r, s, e, m = (x[slice(*np.searchsorted(row, [of.start, of.stop]))] for x in out[0])
            out.extend((r + of.start, s, e, m) for r, s, e, m in _large_group(view[of], lo[of], hi[of], (r - of.start, s, e, m), p))
        row, s, e, m, keep = _widening(*(np.concatenate(x) for x in zip(*out, strict=True)), view.shape[1])
        # a long class of several documents has its whole surroundings anyway, for all but its smallest document
        keep &= (m < lo[row]) | (lo[row] == hi[row]) | ((view[row] != _NONE).sum(axis=1) < p.least)
        own = [t.column(c).combine_chunks().take(pa.array(row)) for c in ("key", "same", "lo")]
        return pa.RecordBatch.from_arrays([*own, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(m.astype(np.int64)), pa.array(keep)], names=["key", "same", "lo", "s", "e", "m", "keep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column("g").to_numpy()
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))
            if cut or held and held[-1].column("g")[-1].as_py() != g[0]:
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]) if cut else pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, s, e, cut) by doc and s become one row a document: intervals that touch or overlap are one."""

    def united(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which = np.cumsum(np.diff(doc, prepend=doc[:1] - 1) != 0)
        reach = np.maximum.accumulate((which << 40) + e)
        new = np.concatenate([[True], (which[1:] << 40) + s[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        return doc[at], s[at], (reach & ((1 << 40) - 1))[np.append(at[1:], len(doc)) - 1]

    def text(s: np.ndarray, e: np.ndarray) -> str:
        return ",".join(f"{a}:{b}" for a, b in zip(s.tolist(), e.tolist(), strict=True))

    def work(t: pa.Table) -> pa.RecordBatch:
        doc, s, e = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "s", "e"))
        cut = t.column("cut").to_numpy()
        d, a, b = united(doc, s, e)
        ids, first = np.unique(d, return_index=True)
        parts = {}
        if cut.any():
            x, u, v = united(doc[cut], s[cut], e[cut])
            own, at = np.unique(x, return_index=True)
            parts = {int(i): text(u[f:to], v[f:to]) for i, f, to in zip(own, at, np.append(at[1:], len(x)), strict=True)}
        to = np.append(first[1:], len(d))
        columns = [pa.array(ids), pa.array((to - first).astype(np.int64)), pa.array(np.add.reduceat(b - a, first)), pa.array([text(a[i:j], b[i:j]) for i, j in zip(first, to, strict=True)], pa.string()), pa.array([parts.get(int(i), "") for i in ids], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_passages", "dup_words", "spans", "cut_spans"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        if not len(doc):
            continue
        cut = int(np.searchsorted(doc, doc[-1]))
        if cut or held and held[-1].column("doc")[-1].as_py() != doc[0]:
            yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]) if cut else pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield work(pa.Table.from_batches(held))


def passages(docs: DataFrame, p: Shape) -> tuple[DataFrame, DataFrame]:
    """doc, s, e (in words, e exclusive), m: a passage of the document, and the smallest document that has it too (its own id, if there is no smaller). And links a, b
    between documents beyond those of m and doc."""
    docs = docs.where("doc_id IS NOT NULL")
    windows = written(_windows(docs, p), "windows")
    shared = windows.groupBy("value").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("value")
    lists = windows.join(shared.hint("shuffle_hash"), "value", "left_semi").groupBy("doc").agg(F.collect_list("at").alias("at"))

    def seq(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, ends = sequences(batch.column(1), p.width)
        at = batch.column(2)
        own = np.repeat(np.arange(len(ends)), np.diff(at.offsets.to_numpy()))
        c = np.append(0, ends)[own] + at.flatten().to_numpy()
        s = _blanked((s >> np.uint64(32)).astype(np.uint32), ends, c[c < ends[own]], p)
        places = np.append(0, 4 * ends).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(s)])
        return pa.RecordBatch.from_arrays([batch.column(0), own, batch.column(2)], names=["doc", "seq", "at"])

    texts = docs.select("doc_id", "text").join(lists.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "at")
    seqs = written(map_arrow(texts, seq, "doc long, seq binary, at array<int>", rows=BATCH), "sequences")
    spent(docs.sparkSession, windows)
    members = _members(seqs, p)
    # one row for each class of equal surroundings, in the groups of either context; then only groups of several documents
    classes = members.groupBy("key", "same").agg(F.min(F.struct("doc", "at", "left", "right", "other")).alias("r"), F.max("doc").alias("hi"))
    classes = written(classes.select("key", "r.other", "same", F.col("r.doc").alias("lo"), "hi", "r.at", "r.left", "r.right"), "classes")
    spent(docs.sparkSession)
    sides = classes.withColumn("of", F.explode(F.array(F.struct(F.col("key").alias("group"), F.col("other").alias("beside")), F.struct(F.col("other").alias("group"), F.col("key").alias("beside")))))
    sides = sides.where("of.group IS NOT NULL").select("of.*", "key", "same", "lo", "hi", "at")
    groups = _groups(sides)
    spent(docs.sparkSession)
    reps = sides.drop("beside").join(groups.select("group", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).hint("shuffle_hash"), "group")
    reps = reps.groupBy(F.col("lo").alias("doc")).agg(F.collect_list(F.struct("group", "key", "same", "lo", "hi", "blocks", "at")).alias("m"))
    reps = written(reps, "representatives")
    spent(docs.sparkSession)
    views = _views(reps.hint("shuffle_hash").join(seqs.select("doc", "seq"), "doc").select("doc", "seq", "m"), p)
    own = F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int")
    each = views.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key", "same", "lo", "hi", "view")
    near = written(each.repartition("g").sortWithinPartitions("g").mapInArrow(_meet(p), "key long, same long, lo long, s int, e int, m long, keep boolean"), "near")
    spent(docs.sparkSession)
    # stretches of one word differ in length: e = -1 stands for each member's own end
    one, long = F.col("left") == -1, F.col("left") + F.col("right") + 1 >= p.least
    equal = classes.where((F.col("lo") != F.col("hi")) & (one | long)).select("key", "same", F.when(one, 0).otherwise(-F.col("left")).alias("s"), F.when(one, -1).otherwise(F.col("right")).alias("e"), F.col("lo").alias("m"))
    spans = near.where("keep").select("key", "same", "s", "e", "m").union(equal)
    found = members.select("key", "same", "doc", "at", "right").join(spans.hint("shuffle_hash"), ["key", "same"])
    return found.select("doc", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.when(F.col("e") == -1, F.col("right")).otherwise(F.col("e")) + p.width).alias("e"), "m"), near.where("m <> lo").select(F.col("m").alias("a"), F.col("lo").alias("b"))


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 80, width: int = WIDTH) -> DataFrame:
    p = Shape(words, percent, width)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found, links = passages(docs, p)
    found = written(found, "passages")
    spent(docs.sparkSession)
    linked = components(found.where("m <> doc").select(F.col("m").alias("a"), F.col("doc").alias("b")).union(links)).withColumnsRenamed({"node": "doc_id", "component": "component_id"})
    each = found.select("doc", "s", "e", (F.col("m") < F.col("doc")).alias("cut")).repartition("doc").sortWithinPartitions("doc", "s")
    merged = each.mapInArrow(_merged, "doc_id long, n_passages long, dup_words long, spans string, cut_spans string")
    return merged.join(linked, "doc_id")
