"""Exact substring dedup by level-wise doubling.

Windows of a base length that occur more than once anywhere are extended to twice that length, level by level, up to
the asked window; what has become unique on the way is dropped at once, and the search ends when no candidate is left.

At the base length not every window is looked up: among the base windows inside each full window the one with the
smallest hash stands for it. Equal full windows choose the same base window at the same place, so nothing is lost, and
about one place in six is sent. Each level is one shuffle on the window's hash. What one batch of documents already
shows to be repeated is settled in that batch and represented there by one row, so a passage that is in a third of all
documents makes one row for each batch and not one for each occurrence.

Defined results: null or blank texts have no words, nothing removed, and the SHA-256 of the empty string. Rows that share
a doc_id count as texts that start at the same place: an equal window at the same position is not an earlier one, so
repeated rows keep what one of them keeps. Rows without doc_id come behind all others, each as a document of its own. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, as_bytes, carrying, cut, grams, hashed_words, keyed_rows, mix

_PROBE = "key long, doc long, at long"
_MARK = "doc long, at long"


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _check(hashes: np.ndarray) -> np.ndarray:
    """22 more bits of each window, by which a mark is told from one of another row with the same doc_id."""
    return mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(42)


#: A mark or probe is one number: 31 bits of position, 9 of how many windows follow each other, 2 of kind, 22 of check.
_MOST = (1 << 9) - 1


def _pack(pos, n, kind, chk) -> np.ndarray:
    u = lambda x: np.asarray(x).astype(np.uint64)
    return (u(pos) | u(n) << np.uint64(31) | u(kind) << np.uint64(40) | u(chk) << np.uint64(42)).view(np.int64)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, number, kind and check."""
    u = np.ascontiguousarray(at).view(np.uint64)
    part = lambda low, bits: ((u >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return part(0, 31), part(31, 9), part(40, 2), part(42, 22)


def _probes(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(at)], names=["key", "doc", "at"])


def _spread(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key for rows that only pass through a shuffle."""
    return mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))


def _base_rows(base: int, window: int):
    """kind 0: one occurrence of a base window in this batch; 1: one of several; 2: the others of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _ids(b.column(0))
            words, bounds = hashed_words(as_bytes(b.column(1)))
            last = bounds[1:] - window
            starts = np.zeros(len(words) + 1, np.int32)
            ok = last >= bounds[:-1]
            np.add.at(starts, bounds[:-1][ok], 1)
            np.add.at(starts, last[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
            if not len(at):
                continue
            value = grams(words, base)
            owner, reach, span = np.arange(len(value)), 1, window - base + 1
            low = value
            while reach < span:
                step = min(reach, span - reach)
                take = low[step:] < low[:-step]
                owner = np.where(take, owner[step:], owner[:-step])
                low = np.where(take, low[step:], low[:-step])
                reach += step
            own = owner[at]
            new = np.ones(len(at), bool)
            new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            place = at[first]
            d = np.searchsorted(bounds, place, side="right") - 1
            doc, pos, key = ids[d], place - bounds[d], value[own[first]]
            order = np.argsort(key, kind="stable")
            ks = key[order]
            lead = np.ones(len(ks), bool)
            lead[1:] = ks[1:] != ks[:-1]
            group = np.cumsum(lead) - 1
            many = np.bincount(group)[group] > 1
            kind = np.where(lead, np.where(many, 1, 0), 2)
            doc, pos, n = doc[order], pos[order], n[order]
            key = np.where(kind == 2, _spread(doc, pos), ks)
            yield _probes(key, doc, _pack(pos, n, kind, np.zeros(len(key))))

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of rows (key, doc, at) in order of key, each with all rows of its keys."""
    held: list[list[np.ndarray]] = []  # pieces of one key, joined once when it ends
    whole = lambda pieces: tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held and now[0][0] != held[-1][0][-1]:
            yield whole(held)
            held = []
        differs = np.flatnonzero(now[0][1:] != now[0][:-1])
        if len(differs):
            at = differs[-1] + 1
            yield whole([*held, [x[:at] for x in now]])
            held, now = [], [x[at:] for x in now]
        held.append(now)
    if held:
        yield whole(held)


def _lead(*columns: np.ndarray) -> np.ndarray:
    """Where a group of equal neighbours begins."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _marks(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], names=["doc", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences of windows that occur more than once."""
    for key, doc, at in _whole_keys(batches):
        kind = _unpack(at)[2]
        group = np.cumsum(_lead(key)) - 1
        count = np.bincount(group, weights=(kind < 2) + (kind == 1).astype(np.int64))
        keep = (kind == 2) | (count[group] > 1)
        yield _marks(doc[keep], at[keep])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences that have an earlier one."""
    for key, doc, at in _whole_keys(batches):
        pos, _, kind, chk = _unpack(at)
        order = np.lexsort((pos, doc, chk, key))
        key, doc, at, pos, kind, chk = (x[order] for x in (key, doc, at, pos, kind, chk))
        lead = _lead(key, chk)
        start = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        keep = (kind == 2) | (doc != doc[start]) | (pos != pos[start])
        yield _marks(doc[keep], at[keep])


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges."""
    total = int(n.sum())
    out = np.ones(total, np.int64)
    if total:
        heads = np.zeros(len(n), np.int64)
        np.cumsum(n[:-1], out=heads[1:])
        live = n > 0
        h, b = heads[live], begin[live]
        e = b + n[live]
        out[h[0]] = b[0]
        out[h[1:]] = b[1:] - e[:-1] + 1
        np.cumsum(out, out=out)
    return out


def _marked_windows(b: pa.RecordBatch, size: int):
    """Each marked place with ``size`` words after it, once: place among the batch's words, hashes, bounds, ids."""
    ids = _ids(b.column(0))
    words, bounds = hashed_words(as_bytes(b.column(1)))
    marks = b.column(2)
    lens = np.diff(marks.offsets.to_numpy()) if len(marks) else np.zeros(0, np.int64)
    pos, n, _, _ = _unpack(marks.flatten().to_numpy(zero_copy_only=False))
    d = np.repeat(np.arange(len(ids)), lens)
    begin = bounds[d] + pos
    n = np.minimum(n, bounds[d + 1] - size + 1 - begin)
    keep = n > 0
    place = np.unique(_ranges(begin[keep], n[keep]))
    return ids, bounds, grams(words, size), place


def _window_rows(size: int, final: bool):
    """The marked windows of ``size`` words as probes; with ``final`` those that a batch settles go as ranges of kind 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, bounds, value, place = _marked_windows(b, size)
            if not len(place):
                continue
            key = value[place]
            d = np.searchsorted(bounds, place, side="right") - 1
            doc, pos, chk = ids[d], place - bounds[d], _check(key).astype(np.int64)
            order = np.lexsort((pos, doc, key))
            ks, ds, ps, cs = key[order], doc[order], pos[order], chk[order]
            lead = _lead(ks)
            one = np.ones(len(ks))
            if not final:
                group = np.cumsum(lead) - 1
                kind = np.where(lead, np.bincount(group)[group] > 1, 2)
                yield _probes(np.where(kind == 2, _spread(ds, ps), ks), ds, _pack(ps, one, kind, cs))
                continue
            yield _probes(ks[lead], ds[lead], _pack(ps, one, 0 * one, cs)[lead])
            start = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            later = np.sort(order[~lead & ((ds != ds[start]) | (ps != ps[start]))])
            if len(later):
                new = _lead(place[later] - np.arange(len(later)), d[later])
                run_of = np.cumsum(new) - 1
                new |= (np.arange(len(later)) - np.flatnonzero(new)[run_of]) % _MOST == 0
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(later)))
                x = np.bitwise_xor.reduceat(chk[later], first)
                doc, pos = doc[later][first], pos[later][first]
                yield _probes(_spread(doc, pos), doc, _pack(pos, n, np.full(len(n), 2), x))

    return run


def _cut_words(size: int, keep_text: bool):
    """The result rows: words that a settled range of windows covers go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            marks = b.column(2)
            has = ~marks.is_null().to_numpy(zero_copy_only=False)
            lens = np.where(has, np.diff(marks.offsets.to_numpy()) if len(marks) else 0, 0)
            pos, n, _, chk = _unpack(marks.flatten().to_numpy(zero_copy_only=False))
            heads = np.concatenate([[0], np.cumsum(lens)])
            n_words, n_removed, kept = [], [], []
            for i in range(b.num_rows):
                words = texts[i].as_py().split()
                n_words.append(len(words))
                gone = 0
                if lens[i]:
                    p, m, c = (x[heads[i] : heads[i + 1]] for x in (pos, n, chk))
                    value = grams(hashed_words(texts[i : i + 1])[0], size)
                    sums = np.zeros(len(value) + 1, np.int64)
                    np.bitwise_xor.accumulate(_check(value).astype(np.int64), out=sums[1:])
                    inside = p + m <= len(value)
                    p, m, c = p[inside], m[inside], c[inside]
                    true = (sums[p + m] ^ sums[p]) == c
                    p, m = p[true], m[true]
                    over = np.zeros(len(words) + 1, np.int64)
                    np.add.at(over, p, 1)
                    np.add.at(over, p + m - 1 + size, -1)
                    stays = np.cumsum(over[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words = list(compress(words, stays.tolist()))
                n_removed.append(gone)
                text = b" ".join(words)
                kept.append(text.decode() if keep_text else hashlib.sha256(text).hexdigest())
            ids = b.column(b.num_columns - 1 if b.num_columns > 3 else 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _by_doc(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc").agg(F.collect_list("at").alias("marks"))


def substring_dedup(docs: DataFrame, window: int = 20, levels: int = 1, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) without the words of windows that also start earlier.

    Args:
        window: words of a window that counts as repeated; a multiple of ``2 ** levels``.
        levels: how often a base window is doubled to reach ``window``.
        keep_text: return the kept words (joined by one space) as ``kept``, else their SHA-256.

    Returns:
        doc_id, n_words, n_removed, kept.
    """
    if window % (1 << levels) or window <= 0:
        raise ValueError("window must be a multiple of 2 ** levels")
    base = window >> levels
    if window - base >= _MOST:
        raise ValueError(f"window minus base window must be below {_MOST}")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # both joins below read the same columns, never null to the planner, so the texts are shuffled once
    all_named = own.filter("doc_id is null").isEmpty()
    if all_named:
        keyed = own.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), "text")
    else:  # ranks stand for the ids, one for all rows with an id and one for each row without
        rows = keyed_rows(own)
        first = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(ROW).alias("first"))
        keyed = rows.join(first, "doc_id", "left").select(F.coalesce("first", ROW).alias("doc"), "text", "doc_id")
    columns = keyed.columns
    probes = keyed.mapInArrow(_base_rows(base, window), _PROBE)
    marks = probes.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, _MARK)
    for level in range(1, levels + 1):
        final = level == levels
        size = base << level
        held = keyed.join(_by_doc(marks), "doc", "left").filter("marks is not null").select("doc", "text", "marks")
        probes = held.mapInArrow(_window_rows(size, final), _PROBE).repartition("key").sortWithinPartitions("key")
        marks = probes.mapInArrow(_later if final else _repeated, _MARK)
        if not final:  # the search ends where no candidate is left
            marks = cut(marks)
            if marks.isEmpty():
                break
    found = keyed.join(_by_doc(marks), "doc", "left").select("doc", "text", "marks", *columns[2:])
    return found.mapInArrow(_cut_words(window, keep_text), "doc_id long, n_words long, n_removed long, kept string")


def query(docs: DataFrame) -> DataFrame:
    """The columns of ``op3``: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(docs, keep_text=False).withColumnRenamed("kept", "kept_sha256")


@carrying
def stage(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words as text and n_chars to match; rows that had words and lose all are dropped."""
    rows = keyed_rows(docs)
    found = substring_dedup(rows.select(F.col(ROW).alias("doc_id"), "text"))
    kept = found.select(F.col("doc_id").alias(ROW), F.col("n_words").alias("_tl_words"), F.col("n_removed").alias("_tl_removed"), F.col("kept").alias("_tl_kept"))
    out = rows.drop("text", "n_chars").join(kept, ROW).filter("_tl_removed = 0 or _tl_removed < _tl_words")
    return out.withColumn("text", F.col("_tl_kept")).withColumn("n_chars", F.length("_tl_kept").cast("long")).select(*docs.columns)
