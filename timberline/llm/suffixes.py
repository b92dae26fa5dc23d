"""Substring dedup of bytes by suffixes that are sorted deep and shallow.

A window is ``length`` bytes of a document. Among the 16-byte grams of a window the one with the smallest hash stands for it, so
equal windows name the same gram at the same place, and the windows that one gram stands for follow each other. Documents are dealt
to blocks by a hash; every pass works on one block.

1. Each block sends the hashes of its grams, once each, to buckets, and gets back which of them other documents have too. False hits do no harm.
2. For these grams each block sends the (compressed) bytes that their windows span, once for each different span with its first document; what the
   block itself shows to be later is settled there. So a passage that is in a third of all documents sends one span for each block.
   A gram that very many rows have (HOT) goes window by window to buckets of the windows' own hashes: equal ones still meet and are sent once for
   each block, and those that straddle the edge of a common passage are spread.
3. A bucket has all spans of a gram. Their suffixes that begin at the same distance before the gram are sorted to the depth
   of a window: by multikey quicksort, eight bytes a step, down to SHALLOW steps; groups that are still together then and are small enough
   go into blind tries, which hold only the bits where suffixes part. What ends in one place is equal byte by byte, and all but those
   of the first document are marked.
4. Each block takes the marked windows out of its texts.

All steps work on arrays of many groups at once. Texts are shuffled once for the three passes over blocks.

Defined results: a null text is empty. Rows with one doc_id are documents that don't come before each other; rows without doc_id come behind all
others, each as a document of its own. What is left needn't be valid UTF-8, so it is binary. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, as_bytes, keyed_rows, mix

#: Bytes of a gram; eight-byte steps of the quicksort; members of a blind trie at most.
GRAM, SHALLOW, TRIE = 16, 2, 64
#: Bytes of text of a block, of a bucket at most and at least.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BYTES = 4 << 20, 64 << 20, 1 << 20
#: Rows with a gram from which on its windows are dealt one by one.
HOT = 1000
#: Bytes that are hashed, and windows that are sorted, at once.
_PIECE, _WINDOWS = 1 << 18, 1 << 20
_PLACE = 26
_SALT = np.uint64(0x9E3779B97F4A7C15)


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of ``n`` numbers from ``begin`` on."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def words_of(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray(max(0, len(data) - 7), kind, data.data, 0, (1,))


class Block:
    """The texts of a block in the order of their rows, as one buffer."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("doc")
        self.ids, self.order = table.column("doc_id").combine_chunks(), table.column("ord").to_numpy()
        texts = as_bytes(table.column("text"))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.raw = b"" if raw is None else raw.to_pybytes()[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = np.frombuffer(self.raw + b"\0" * 16, np.uint8)
        self.native = words_of(self.data, "<u8")

    def hashed(self, lo: int, hi: int) -> np.ndarray:
        return mix(mix(self.native[lo:hi] * _SALT) + self.native[lo + 8 : hi + 8])

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, place) of each gram that stands for windows."""
        total, span = len(self.raw), length - GRAM + 1
        size = np.diff(self.offsets)
        first = self.offsets[:-1][size >= length]
        n = size[size >= length] - length + 1
        valid = np.zeros(total + 1, np.int32)
        valid[first] = 1
        np.add.at(valid, first + n, -1)
        valid = np.cumsum(valid)[:total].astype(bool)
        starts, owners, last = [], [], -1
        for lo in range(0, total, _PIECE):
            hi = min(total, lo + _PIECE)
            far = min(total - GRAM + 1, hi + span - 1)
            if far <= lo:
                break
            # the place in the low bits: the first of equal hashes wins and is known at once
            low = (self.hashed(lo, far) >> np.uint64(_PLACE)) << np.uint64(_PLACE) | np.arange(far - lo, dtype=np.uint64)
            reach = 1
            while reach < span:
                step = min(reach, span - reach)
                np.minimum(low[: len(low) - step], low[step:], out=low[: len(low) - step])
                reach += step
            at = np.flatnonzero(valid[lo : min(hi, far)])
            own = (low[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + lo
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            if len(own) and own[0] == last:
                new[0] = False
            if len(own):
                last = own[-1]
            starts.append(at[new] + lo)
            owners.append(own[new])
        starts, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owners))
        # windows are told apart by their places among the valid ones
        rank = np.cumsum(valid) - 1 if len(valid) else np.zeros(0, np.int64)
        place = rank[starts]
        return starts, np.diff(np.append(place, int(valid.sum()))), owners

    def keys(self, places: np.ndarray, buckets: int) -> np.ndarray:
        """bucket << 31 | 31 more bits of the hash of each gram."""
        h = mix(mix(self.native[places] * _SALT) + self.native[places + 8]) * _SALT
        h ^= h >> np.uint64(29)
        return ((h % np.uint64(buckets)).astype(np.int64) << 31) | (h >> np.uint64(33)).astype(np.int64)

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1


def _lead(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as binaries."""
    values = np.ascontiguousarray(values)
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binaries, and how many each has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


_SENT = "block long, bucket long, keys binary, often binary"
_SEEN = "block long, bucket long, bits binary, hot binary"


def _different(block: Block, length: int, buckets: int):
    """The grams of a block, their keys in order, the place of each gram among the different keys."""
    first, n, place = block.grams(length)
    key = block.keys(place, buckets)
    order = np.argsort(key, kind="stable")
    lead = _lead(key[order])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(lead) - 1
    return first, n, place, key[order][lead], inverse, order, lead


def send_grams(length: int, buckets: int):
    """Each different key of a block once, and how many of its rows have it (65,535 at most)."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        first, _, _, keys, _, order, lead = _different(block, length, buckets)
        row = block.owner(first)[order]
        start = np.flatnonzero(lead)
        new = np.ones(len(row), bool)
        new[1:] = lead[1:] | (row[1:] != row[:-1])
        often = np.add.reduceat(new.astype(np.int64), start) if len(start) else start
        bucket = keys >> 31
        heads = np.flatnonzero(_lead(bucket)) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(keys)))
        own = table.column("block")[0].as_py()
        columns = [pa.array(np.full(len(heads), own)), pa.array(bucket[heads]), _binaries((keys & ((1 << 31) - 1)).astype(np.uint32), counts), _binaries(np.minimum(often, 65_535).astype(np.uint16), counts)]
        return pa.table(columns, names=["block", "bucket", "keys", "often"])

    return run


def meet_grams(table: pa.Table) -> pa.Table:
    """For each row of a bucket two bits for each of its keys: whether several documents have it, and whether very many have."""
    keys, counts = _joined(table.column("keys"), np.uint32)
    often, _ = _joined(table.column("often"), np.uint16)
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(_lead(keys[order])) - 1
    seen = np.bincount(group, weights=often[order].astype(float)) if len(group) else np.zeros(0)
    total = np.empty(len(keys))
    total[order] = seen[group]
    ends = np.cumsum(counts)
    bits = lambda x: pa.array([np.packbits(x[e - c : e]).tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.table([table.column("block"), table.column("bucket"), bits(total > 1), bits(total >= HOT)], names=["block", "bucket", "bits", "hot"])


_SPANS = "block long, bucket long, settled binary, key binary, n binary, off binary, ord binary, text binary, entries binary, entry_row binary, entry_at binary"


def _settle(block: Block, first: np.ndarray, n: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each span the first one of the block with the same bytes, gram place and number of windows, and a hash of these."""
    end = first + n - 1 + length
    h = mix(n.astype(np.uint64) * _SALT + off.astype(np.uint64))
    steps = range(0, int((end - first).max()) + 1 if len(n) else 0, 8)
    for j in steps:
        h = mix(h * _SALT + block.native[np.minimum(first + j, end - 8)])
    order = np.argsort(h, kind="stable")
    head = np.empty(len(n), np.int64)
    lead = _lead(h[order])
    head[order] = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(n) else order
    same = (n == n[head]) & (off == off[head])
    for j in steps:
        at = np.minimum(first + j, end - 8)
        same &= block.native[at] == block.native[at[head]]
    return np.where(same, head, np.arange(len(n))), h


@dataclass
class Spans:
    """Spans of a block's texts: first window, number of windows, bytes from there to the gram, key (bucket and 31 bits)."""

    first: np.ndarray
    n: np.ndarray
    off: np.ndarray
    key: np.ndarray

    def take(self, at: np.ndarray) -> Spans:
        return Spans(self.first[at], self.n[at], self.off[at], self.key[at])

    def windows(self) -> Spans:
        """Each window as a span of its own."""
        of = np.repeat(np.arange(len(self.n)), self.n)
        inside = ranges(np.zeros(len(self.n), np.int64), self.n)
        return Spans(self.first[of] + inside, np.ones(len(of), np.int64), self.off[of] - inside, self.key[of])

    def settled(self, block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of them an earlier document of the block has too, the first equal one of each, and the hashes."""
        head, h = _settle(block, self.first, self.n, self.off, length)
        ord_ = block.order[block.owner(self.first)]
        least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(least, head, ord_)
        return ord_ > least[head], head, h


def _glued(block: Block, parts: list[Spans]) -> np.ndarray:
    """(row, first window, number of windows) of settled spans, those that follow each other as one."""
    first, n = (np.concatenate([getattr(p, c) for p in parts]) for c in ("first", "n"))
    order = np.argsort(first, kind="stable")
    first, n = first[order], n[order]
    row = block.owner(first)
    new = np.ones(len(n), bool)
    new[1:] = (first[1:] != first[:-1] + n[:-1]) | (row[1:] != row[:-1])
    g = np.flatnonzero(new)
    total = np.add.reduceat(n, g) if len(g) else n
    return np.column_stack([row[g], first[g] - block.offsets[row[g]], total]).astype(np.uint32)


def send_spans(length: int, buckets: int):
    def run(table: pa.Table, seen: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _SPANS.split(", ")]
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 9)], names=names)
        if not table.num_rows or not seen.num_rows:
            return empty
        block, own = Block(table), table.column("block")[0].as_py()
        first, n, place, keys, inverse, _, _ = _different(block, length, buckets)
        bits = {b: x for b, *x in zip(*(seen.column(c).to_pylist() for c in ("bucket", "bits", "hot")), strict=True)}
        bucket = keys >> 31
        heads = np.flatnonzero(_lead(bucket)) if len(keys) else np.zeros(0, np.int64)
        hit, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(keys)).tolist(), strict=True):
            for out, x in zip((hit, hot), bits[int(bucket[lo])], strict=True):
                out[lo:hi] = np.unpackbits(np.frombuffer(x, np.uint8), count=hi - lo)
        live = np.flatnonzero(hit[inverse])
        if not len(live):
            return empty
        spans = Spans(first[live], n[live], (place - first)[live], keys[inverse[live]])
        later, head, _ = spans.settled(block, length)
        gone, split = [spans.take(np.flatnonzero(later))], hot[inverse[live]] & ~later
        open_, same = spans.take(np.flatnonzero(~later & ~split)), head[~later & ~split]
        if split.any():
            single = spans.take(np.flatnonzero(split)).windows()
            later, head, h = single.settled(block, length)
            gone.append(single.take(np.flatnonzero(later)))
            single.key = ((h % np.uint64(buckets)).astype(np.int64) << 31) | (h >> np.uint64(33)).astype(np.int64)
            left = single.take(np.flatnonzero(~later))
            open_ = Spans(*(np.concatenate([getattr(open_, c), getattr(left, c)]) for c in ("first", "n", "off", "key")))
            same = np.concatenate([same, head[~later] + len(live)])
        # the entries of a span's first document stay open, the span goes once
        order = np.lexsort((np.arange(len(same)), same, open_.key >> 31))
        open_, same = open_.take(order), same[order]
        row = block.owner(open_.first)
        lead = _lead(same)
        span, of_span = open_.take(np.flatnonzero(lead)), np.cumsum(lead) - 1
        b = span.key >> 31
        tops = np.flatnonzero(_lead(b))
        counts = np.diff(np.append(tops, len(b)))
        row_of_span = np.repeat(np.arange(len(tops)), counts)
        entries = np.bincount(row_of_span[of_span], minlength=len(tops))
        raw = block.raw
        texts = [raw[i:j] for i, j in zip(span.first.tolist(), (span.first + span.n - 1 + length).tolist(), strict=True)]
        text = [pa.compress(b"".join(texts[i:j]), "zstd", asbytes=True) for i, j in zip(tops.tolist(), np.append(tops[1:], len(b)).tolist(), strict=True)]
        settled = _glued(block, gone)  # dealt to the rows in turn
        share = np.full(len(tops), len(settled) // len(tops))
        share[: len(settled) % len(tops)] += 1
        columns = [
            pa.array(np.full(len(tops), own)), pa.array(b[tops]), _binaries(settled.ravel(), share * 3), _binaries((span.key & ((1 << 31) - 1)).astype(np.uint32), counts),
            _binaries(span.n.astype(np.uint16), counts), _binaries(span.off.astype(np.uint16), counts), _binaries(block.order[row[lead]], counts), pa.array(text, pa.binary()),
            _binaries((of_span - tops[row_of_span[of_span]]).astype(np.uint32), entries), _binaries(row.astype(np.uint32), entries), _binaries((open_.first - block.offsets[row]).astype(np.uint32), entries),
        ]
        return pa.table(columns, names=names)

    return run


class Windows:
    """Strings of ``length`` bytes from ``start`` on in a buffer that has eight bytes behind the last one."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: int):
        self.view, self.start, self.length = words_of(data, ">u8"), start, length
        self.steps = -(-length // 8)
        self.last = np.uint64(((1 << 64) - 1) ^ ((1 << (8 * (8 * self.steps - length))) - 1))

    def word(self, at: np.ndarray, step) -> np.ndarray:
        """The bytes of the windows ``at`` from 8 * step on as a number, those behind the window being zero."""
        out = self.view[self.start[at] + 8 * step].astype(np.uint64)
        if np.ndim(step):
            return np.where(step == self.steps - 1, out & self.last, out)
        return out & self.last if step == self.steps - 1 else out

    def bit(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (self.word(at, place >> 6) >> (63 - (place & 63)).astype(np.uint64)) & np.uint64(1) > 0


def _top_bit(x: np.ndarray) -> np.ndarray:
    """The place of the highest bit that is set, counted from the left."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])


def sort_windows(win: Windows, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows in the order of group and bytes, and where one begins that differs from the one before it."""
    order = np.argsort(group, kind="stable")
    lead = _lead(group[order])
    lo = np.flatnonzero(lead)
    hi = np.append(lo[1:], len(order))
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    step = np.zeros(len(lo), np.int64)
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lo):
        blind = (step >= SHALLOW) & (hi - lo <= TRIE)
        deep.append((lo[blind], hi[blind]))
        lo, hi, step = lo[~blind], hi[~blind], step[~blind]
        if not len(lo):
            break
        lo, hi, step = _split(win, order, lead, lo, hi, step)
    if deep:
        blind_tries(win, order, lead, np.concatenate([x for x, _ in deep]), np.concatenate([x for _, x in deep]))
    return order, lead


def _split(win: Windows, order: np.ndarray, lead: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray):
    """One step of multikey quicksort for all segments: less than the pivot, equal (which go on one step deeper), greater."""
    size = hi - lo
    head = np.cumsum(size) - size
    seg = np.repeat(np.arange(len(lo)), size)
    x = order[ranges(lo, size)]
    w = win.word(x, step[seg])
    a, b, c = w[head], w[head + size // 2], w[head + size - 1]
    pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
    less, equal = w < pivot, w == pivot
    more = ~(less | equal)
    place = np.empty(len(x), np.int64)
    begin, cuts = lo, [lo]
    for part in (less, equal, more):
        count = np.cumsum(part)
        base = count[head] - part[head]
        place[part] = (begin[seg] + count - 1 - base[seg])[part]
        begin = begin + count[head + size - 1] - base
        cuts.append(begin)
    order[place] = x
    lead[cuts[1]] = True
    lead[cuts[2][cuts[2] < hi]] = True
    bounds = [(cuts[0], cuts[1], step), (cuts[1], cuts[2], step + 1), (cuts[2], cuts[3], step)]
    low, high, deeper = (np.concatenate([part[i] for part in bounds]) for i in range(3))
    on = (high - low > 1) & (deeper < win.steps)
    return low[on], high[on], deeper[on]


def blind_tries(win: Windows, order: np.ndarray, lead: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Puts the segments, whose windows agree in SHALLOW steps, in order, by a trie for each segment.

    A node has only the place of the bit where its two sides differ. A window goes down by these bits alone to some leaf, is
    compared with it once, and then gets its node where the first differing bit belongs. The i-th windows of all segments go in together.
    """
    by = np.argsort(lo - hi, kind="stable")
    lo, hi = lo[by], hi[by]
    size = hi - lo
    n = int(size.sum())
    base = np.cumsum(size) - size
    own = order[ranges(lo, size)]
    where, left, right = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaf, after, before = np.arange(n), np.full(n, -1), np.full(n, -1)
    root, first = -base - 1, base.copy()

    def down(now: np.ndarray, x: np.ndarray, until: np.ndarray | None = None):
        """From ``now`` by the bits of ``x`` to a leaf, or to the first node below the bit ``until``; the last node passed and the side taken."""
        above, side = np.full(len(now), -1), np.zeros(len(now), bool)
        on = np.flatnonzero(now >= 0)
        while len(on):
            node = now[on]
            if until is not None:
                go = where[node] < until[on]
                on, node = on[go], node[go]
                if not len(on):
                    break
            s = win.bit(own[x[on]], where[node])
            above[on], side[on] = node, s
            now[on] = np.where(s, right[node], left[node])
            on = on[now[on] >= 0]
        return now, above, side

    for i in range(1, int(size[0]) if len(size) else 0):
        live = np.arange(int(np.searchsorted(-size, -i, side="left")))
        x = base[live] + i
        found = -down(root[live].copy(), x)[0] - 1
        differ = np.full(len(x), -1)
        rest = np.arange(len(x))
        for step in range(SHALLOW, win.steps):
            d = win.word(own[x[rest]], step) ^ win.word(own[found[rest]], step)
            some = d > 0
            differ[rest[some]] = 64 * step + _top_bit(d[some])
            rest = rest[~some]
        leaf[x[rest]] = leaf[found[rest]]
        new = np.flatnonzero(differ >= 0)
        if not len(new):
            continue
        x, g, bit = x[new], live[new], differ[new]
        side_of = win.bit(own[x], bit)
        below, above, side = down(root[g].copy(), x, bit)
        where[x] = bit
        left[x], right[x] = np.where(side_of, below, -x - 1), np.where(side_of, -x - 1, below)
        top = above < 0
        root[g[top]] = x[top]
        a, s, new_node = above[~top], side[~top], x[~top]
        right[a[s]], left[a[~s]] = new_node[s], new_node[~s]
        # the neighbour in the order is the nearest leaf of the subtree that was there
        edge = below.copy()
        on = np.flatnonzero(edge >= 0)
        while len(on):
            edge[on] = np.where(side_of[on], right[edge[on]], left[edge[on]])
            on = on[edge[on] >= 0]
        edge = -edge - 1
        prev, nxt = np.where(side_of, edge, before[edge]), np.where(side_of, after[edge], edge)
        before[x], after[x] = prev, nxt
        after[prev[prev >= 0]] = x[prev >= 0]
        before[nxt[nxt >= 0]] = x[nxt >= 0]
        heads = prev < 0
        first[g[heads]] = x[heads]
    several = np.flatnonzero(after[first] >= 0)
    if not len(several):
        return
    rank, now, r = np.zeros(n, np.int64), first[several], 0
    while len(now):
        rank[now] = r
        now, r = after[now], r + 1
        now = now[now >= 0]
    at = ranges(base[several], size[several])
    seg = np.repeat(np.arange(len(several)), size[several])
    ranks = rank[leaf[at]]
    sort = np.lexsort((ranks, seg))
    out = ranges(lo[several], size[several])
    order[out] = own[at[sort]]
    starts = np.ones(len(sort), bool)
    starts[1:] = (ranks[sort][1:] != ranks[sort][:-1]) | (seg[1:] != seg[:-1])
    lead[out] = starts


def _later(data: np.ndarray, at: np.ndarray, key: np.ndarray, n: np.ndarray, off: np.ndarray, ord_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, first window, number of windows) of the windows that a span with a smaller ``ord_`` has too."""
    span = np.repeat(np.arange(len(n)), n)
    inside = ranges(np.zeros(len(n), np.int64), n)
    group = key[span] * length + (off[span] - inside)
    order, lead = sort_windows(Windows(data, at[span] + inside, length), group)
    start = np.flatnonzero(lead)
    rank = ord_[span[order]]
    gone = np.zeros(len(span), bool)
    gone[order] = rank > np.minimum.reduceat(rank, start)[np.cumsum(lead) - 1]
    hit = np.flatnonzero(gone)
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (span[hit][1:] != span[hit][:-1])
    heads = np.flatnonzero(new)
    return span[hit[heads]], inside[hit[heads]], np.diff(np.append(heads, len(hit)))


_RANGES = "block long, ranges binary"


def mark_spans(length: int):
    """The ranges (row of the block, first window, number of windows) that go, one binary for each block of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        settled, _ = _joined(table.column("settled"), np.uint32)
        _, of_row = _joined(table.column("settled"), np.dtype("V12"))
        key, counts = _joined(table.column("key"), np.uint32)
        n, off, ord_ = (_joined(table.column(c), k)[0] for c, k in (("n", np.uint16), ("off", np.uint16), ("ord", np.int64)))
        entry, entries = _joined(table.column("entries"), np.uint32)
        row, at = (_joined(table.column(c), np.uint32)[0] for c in ("entry_row", "entry_at"))
        key, n, off = key.astype(np.int64), n.astype(np.int64), off.astype(np.int64)
        sizes = n - 1 + length
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        texts = [pa.decompress(x, size, "zstd", asbytes=True) for x, size in zip(table.column("text").to_pylist(), np.diff(ends).tolist(), strict=True)]
        data = np.frombuffer(b"".join([*texts, b"\0" * 8]), np.uint8)
        start = np.cumsum(sizes) - sizes
        # only grams that several documents have, in pieces of whole grams
        order = np.argsort(key, kind="stable")
        lead = _lead(key[order])
        heads = np.flatnonzero(lead)
        several = (np.minimum.reduceat(ord_[order], heads) != np.maximum.reduceat(ord_[order], heads))[np.cumsum(lead) - 1] if len(key) else lead
        order = order[several]
        done = np.cumsum(n[order])
        heads = np.flatnonzero(_lead(key[order]))
        found, lo = [], 0
        while lo < len(order):
            reach = int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _WINDOWS, side="right"))
            k = int(np.searchsorted(heads, reach, side="right"))
            hi = int(heads[k - 1]) if k and heads[k - 1] > lo else int(heads[k]) if k < len(heads) else len(order)
            if reach >= len(order):
                hi = len(order)
            own = order[lo:hi]
            s, first, many = _later(data, start[own], key[own], n[own], off[own], ord_[own], length)
            found.append((own[s], first, many))
            lo = hi
        span, first, many = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        # each range counts for all entries of its span
        row_base = np.repeat(np.cumsum(counts) - counts, entries)
        of_span = row_base + entry
        by = np.argsort(of_span, kind="stable")
        lo, hi = np.searchsorted(of_span[by], span, side="left"), np.searchsorted(of_span[by], span, side="right")
        e = by[ranges(lo, hi - lo)]
        first, many = np.repeat(first, hi - lo), np.repeat(many, hi - lo)
        of_entry = np.repeat(np.arange(len(entries)), entries)[e]
        made = np.column_stack([row[e], at[e].astype(np.int64) + first, many]).astype(np.uint32)
        sort = np.argsort(of_entry, kind="stable")
        both = np.concatenate([settled.reshape(-1, 3), made[sort]])
        where = np.concatenate([np.repeat(np.arange(len(of_row)), of_row), of_entry[sort]])
        sort = np.argsort(where, kind="stable")
        return pa.table([table.column("block"), _binaries(both[sort].ravel(), 3 * np.bincount(where, minlength=len(of_row)))], names=["block", "ranges"])

    return run


def cut_windows(length: int, keep: bool):
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are left, or their SHA-256."""

    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        kind = pa.binary() if keep else pa.string()
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, kind)], names=names)
        block = Block(table)
        found = _joined(marks.column("ranges"), np.uint32)[0].reshape(-1, 3).astype(np.int64)
        over = np.zeros(len(block.raw) + 1, np.int32)
        begin = block.offsets[found[:, 0]] + found[:, 1]
        np.add.at(over, begin, 1)
        np.add.at(over, begin + found[:, 2] - 1 + length, -1)
        gone = np.cumsum(over)[:-1] > 0
        rises = gone.copy()
        rises[1:] &= ~gone[:-1]
        starts = block.offsets[:-1][np.diff(block.offsets) > 0]
        rises[starts] = gone[starts]
        counts = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets])
        removed, spans = counts(gone), counts(rises)
        left = block.data[: len(gone)][~gone].tobytes()
        ends = np.cumsum(np.diff(block.offsets) - removed)
        parts = [left[i:j] for i, j in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
        kept = parts if keep else [hashlib.sha256(x).hexdigest() for x in parts]
        return pa.table([block.ids, pa.array(np.diff(block.offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(kept, kind)], names=names)

    return run


def _ordered(docs: DataFrame) -> DataFrame:
    """doc (of each row its own), ord (smaller: an earlier document), doc_id, text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keyed_rows(own)
    if rows.filter(~F.col(ROW).eqNullSafe(F.col("doc_id"))).isEmpty():
        return rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.coalesce("doc_id", F.lit(0)).alias("ord"), "doc_id", "text")
    first = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(ROW).alias("ord"))
    return rows.join(first, "doc_id", "left").select(F.col(ROW).alias("doc"), F.coalesce("ord", ROW).alias("ord"), "doc_id", "text")


def suffix_dedup(docs: DataFrame, length: int = 50, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of each row of ``docs`` (doc_id, text).

    Args:
        length: bytes of a window, more than a gram has; each byte that a window covers which also starts in an earlier document goes.
        keep: return what is left, else its SHA-256.
    """
    if not GRAM < length < 1 << 15:
        raise ValueError(f"length must be above {GRAM} and below {1 << 15}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_BYTES)), -(-total // BUCKET_BYTES), 1)
    own = _ordered(docs).withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks).cast("long")))
    seen = own.groupBy("block").applyInArrow(send_grams(length, buckets), _SENT).groupBy("bucket").applyInArrow(meet_grams, _SEEN)
    spans = own.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(send_spans(length, buckets), _SPANS)
    marks = spans.groupBy("bucket").applyInArrow(mark_spans(length), _RANGES)
    kind = "binary" if keep else "string"
    return own.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cut_windows(length, keep), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")


def query(docs: DataFrame) -> DataFrame:
    """The columns of ``op13``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(docs, keep=False).withColumnRenamed("kept", "kept_sha256")
