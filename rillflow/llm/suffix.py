"""Suffix-array dedup by longest-previous-factor arrays (operator 4).

`longest_previous_factor` works on one byte block: suffixes are ordered by
prefix doubling (only suffixes that still tie are sorted again), and the
previous and next smaller positions in that order are the only earlier
positions that can hold the longest match.  With positions negated the same
pass finds later matches.

Across the corpus, `remove_repeated_bytes` first settles all windows that
anchors settle (see repeats.py).  The different contexts of the remaining
anchors are dealt by anchor and put through the arrays in blocks of bounded
size.  An anchor with more than HOT different contexts is not sent to one task:
its windows are hashed and counted with map-side combination, which is as exact.

`remove_repeated_bytes` takes all copies away, `remove_later_copies` keeps the first one: there a window goes
only if an earlier one is equal, so contexts are put into the arrays in the order of their places and only
earlier matches count.

Defined results: null text is empty; matches never cross documents; a text that
occurs twice loses all its bytes if it has `length` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .repeats import RUNS, WINDOW, _wanted, candidates, carried, contexts, covered, expand, later_windows, occurrences, removals, restored, runs, shared_windows, spread, windows_of, with_content

SEED_BYTES = 40
HOT = 16384
BLOCK = 1 << 20
SEGMENT = "key long, ctx long, n int, bytes binary"


class SuffixOrder:
    """Suffixes at `starts` ordered by their first `cap` bytes; ranks at each doubled length."""

    def __init__(self, data: np.ndarray, cap: int, levels: bool = True):
        n = len(data)
        self.n, self.cap = n, cap
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k : k + n]
        width = min(8, cap)
        if width < 8:
            word >>= np.uint64(8 * (8 - width))
        rank, live = _dense(word)
        self.levels = [(width, rank)]
        while width < cap:
            step = min(width, cap - width)
            rank = rank.copy()
            if len(live):
                later = live + step
                tail = np.full(len(live), -1, np.int64)
                inside = later < n
                tail[inside] = self.levels[-1][1][later[inside]]
                head = rank[live]
                pair = head * (n + 1) + (tail + 1)
                order = np.argsort(pair)
                h, pair = head[order], pair[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = h[1:] != h[:-1]
                split = np.ones(len(order), bool)
                split[1:] = pair[1:] != pair[:-1]
                group = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
                sub = np.maximum.accumulate(np.where(split, np.arange(len(order)), 0))
                rank[live[order]] = h + (sub - group)
                size = np.diff(np.append(np.flatnonzero(split), len(order)))
                live = live[order][np.repeat(size > 1, size)]
            width += step
            self.levels = [*(self.levels if levels else []), (width, rank)]  # lengths of matches need all levels
        self.rank, self.tied = rank, live

    def order(self, among: np.ndarray | None = None) -> np.ndarray:
        """Positions (all, or those in `among`) in suffix order; equal prefixes by position."""
        at = np.arange(self.n) if among is None else np.sort(among)
        return at[np.argsort(self.rank[at] * self.n + at)]

    def common(self, i: np.ndarray, j: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, at most cap; j < 0 gives 0."""
        ok = j >= 0
        a, b, have = np.where(ok, i, 0), np.where(ok, j, 0), np.zeros(len(i), np.int64)
        top_width, top = self.levels[-1]
        whole = top[a] == top[b]
        for width, rank in reversed(self.levels):
            pa_, pb = a + have, b + have
            fits = (pa_ < self.n) & (pb < self.n)
            same = fits & (rank[np.minimum(pa_, self.n - 1)] == rank[np.minimum(pb, self.n - 1)])
            have += np.where(same, width, 0)
        for _ in range(8):
            pa_, pb = a + have, b + have
            fits = (pa_ < self.n) & (pb < self.n)
            have += fits & (data[np.minimum(pa_, self.n - 1)] == data[np.minimum(pb, self.n - 1)])
        have = np.where(whole, top_width, np.minimum(have, self.cap))
        return np.where(ok, np.minimum(have, self.n - np.maximum(a, b)), 0)


def _dense(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every value (count of smaller ones) and the positions whose value is not unique."""
    order = np.argsort(word)
    w = word[order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
    rank = np.empty(len(w), np.int64)
    rank[order] = first
    size = np.diff(np.append(np.flatnonzero(new), len(w)))
    return rank, order[np.repeat(size > 1, size)]


def smaller_neighbours(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next index with a smaller value (-1 if none), by pointer jumping."""
    n = len(value)
    guarded = np.append(value, -1)  # index n, also reached as -1, is smaller than all
    out = []
    for step in (-1, 1):
        at = np.arange(n) + step
        at[at < 0] = n
        live = np.flatnonzero(guarded[at] > value)
        while len(live):
            at[live] = at[at[live]]
            live = live[guarded[at[live]] > value[live]]
        at[at == n] = -1
        out.append(at)
    return out[0], out[1]


def longest_previous_factor(data: np.ndarray, cap: int, later: bool = False, order: SuffixOrder | None = None, full: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For every position: length (at most cap) and place of the longest match that starts earlier.

    later=True: the longest match that starts later.  Ties take the previous smaller one.
    full=True: only matches of the whole cap count, others are 0.  Such a match is between
    suffixes that tie at the cap, so the array is built over those alone."""
    length, place = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
    if not len(data):
        return length, place
    suffixes = order or SuffixOrder(data, cap)
    sa = suffixes.order(suffixes.tied if full else None)
    before, after = smaller_neighbours(len(data) - 1 - sa if later else sa)
    one = np.where(before >= 0, sa[before], -1)
    two = np.where(after >= 0, sa[after], -1)
    if full:
        rank = suffixes.rank
        a, b = (np.where((x >= 0) & (rank[x] == rank[sa]), cap, 0) for x in (one, two))
    else:
        a, b = suffixes.common(sa, one, data), suffixes.common(sa, two, data)
    length[sa] = np.maximum(a, b)
    place[sa] = np.where(a >= b, one, two)
    place[length == 0] = -1
    return length, place


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parts with separators that occur once (0xFF is in no UTF-8 text), and where each part starts."""
    pieces, starts, at = [], [], 0
    for i, part in enumerate(parts):
        starts.append(at)
        pieces += [part, b"\xff" + i.to_bytes(4, "big") + b"\xff"]
        at += len(part) + 6
    return np.frombuffer(b"".join(pieces), np.uint8), np.asarray(starts, np.int64)


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, _, key, ctx, lo, n in _wanted(batch, "byte"):
            if len(key):
                parts = [b.buf[s : s + m + length - 1].tobytes() for s, m in zip(lo.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), pa.array(n.astype(np.int32)), pa.array(parts, pa.binary())], names=["key", "ctx", "n", "bytes"])


def _factor_blocks(batches: Iterator[pa.RecordBatch], length: int, sides: tuple[bool, ...] = (False, True)) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor -> runs of windows with an earlier (False) or later (True) match, in blocks of whole anchors."""
    keys, ctxs, counts, parts, held = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        data, starts = joined(parts)
        order = SuffixOrder(data, length, levels=False)
        hit = np.any([longest_previous_factor(data, length, later=x, order=order, full=True)[0] >= length for x in sides], axis=0)
        lo, hi = zip(*(runs(hit[s : s + n]) for s, n in zip(starts.tolist(), counts, strict=True)), strict=True)
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ctxs, pa.int64()), pa.array(lo, kind), pa.array(hi, kind)], names=["key", "ctx", "run_lo", "run_hi"])

    for batch in batches:
        for key, ctx, n, part in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held >= BLOCK and key != keys[-1]:
                yield flush()
                keys, ctxs, counts, parts, held = [], [], [], [], 0
            keys.append(key)
            ctxs.append(ctx)
            counts.append(n)
            parts.append(part)
            held += len(part)
    if parts:
        yield flush()


def _without(wide: DataFrame, docs: DataFrame, text: str, length: int) -> DataFrame:
    """wide(row, text, run_lo, run_hi): the columns of docs with n_bytes, n_removed, n_spans and kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, kept = [], [], [], []
            lows, highs = batch.column(2), batch.column(3)
            for i, value in enumerate(batch.column(1)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                lo = lows[i].values if lows[i].is_valid else None
                mask = None if lo is None else covered(len(raw), length, lo.to_numpy(), highs[i].values.to_numpy())
                total.append(len(raw))
                if mask is None or not mask.any():
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                else:
                    removed.append(int(mask.sum()))
                    spans.append(len(runs(mask)[0]))
                    kept.append(np.frombuffer(raw, np.uint8)[~mask].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["row", "text", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    row = wide.schema["row"].dataType.simpleString()
    out = wide.select("row", "text", "run_lo", "run_hi").mapInArrow(cut, f"row {row}, text string, n_bytes long, n_removed long, n_spans long, kept binary")
    return restored(out, docs, text, ["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, length: int = 200, text: str = "text", seed: int = SEED_BYTES, hot: int = HOT) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (remaining bytes, binary) to every row."""
    seed = min(seed, length)
    base, scope = with_content(carried(docs, text)), scratch.Scope(docs.sparkSession)
    cand = candidates(base, "byte", length, seed, scope)
    ctxs = contexts(cand)
    sized = ctxs.join(spread(ctxs.groupBy("key").agg((F.count("*") > hot).alias("hot"))), "key")
    hashed = shared_windows(expand(base, sized.filter("hot"), windows_of("byte", length), WINDOW))
    parts = expand(base, sized.filter("not hot"), lambda b: _segments(b, length), SEGMENT)
    dealt = parts.repartition("key").sortWithinPartitions("key")
    factored = dealt.mapInArrow(lambda b: _factor_blocks(b, length), RUNS).filter("size(run_lo) > 0")
    found = scratch.table(removals(base, cand, ctxs, hashed.unionByName(factored)), "removals")
    scope.close()

    return _without(base.join(found, ["c1", "c2"], "left"), docs, text, length)


def _placed_segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """As `_segments`, with the place of each context."""
    for batch in batches:
        want = batch.column(1)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(want.offsets))))
        flat, parts = want.flatten(), list(_segments(iter([batch]), length))
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            columns = [t[name].combine_chunks() for name in ("key", "ctx", "n", "bytes")]
            yield pa.RecordBatch.from_arrays([*columns, flat.field(4), batch.column(2).take(rows), batch.column(3).take(rows), flat.field(2)], names=["key", "ctx", "n", "bytes", "o", "c1", "c2", "lo"])


def remove_later_copies(docs: DataFrame, length: int = 200, order: str = "doc_id", text: str = "text", seed: int = SEED_BYTES, hot: int = HOT) -> DataFrame:
    """As `remove_repeated_bytes`, but the first copy of everything stays: a byte goes if a string of `length` bytes that
    covers it also starts earlier, in a row of smaller `order` (a whole number, null last; ties by text) or before in the
    same text.  Rows of equal order and text are one document and stay or go alike."""
    seed, scope = min(seed, length), scratch.Scope(docs.sparkSession)
    base = with_content(carried(docs, text))
    base = base.withColumn("o", F.coalesce(F.col("row").getField(order).cast("long"), F.lit((1 << 63) - 1)))
    found = scope.table(occurrences(base, "byte", length, seed, order=True), "anchors")
    place = F.struct("o", "c1", "c2", "lo")
    known = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("ctx").alias("x0"), F.max("ctx").alias("x1"))
    known = known.filter("first != last").select("key", "first", F.expr("x0 != x1").alias("multi"))
    cand = scope.table(found.join(spread(known), "key"), "candidates")
    ends = [F.col("lo").alias("a"), F.expr("lo + n - 1").alias("b")]
    whole = cand.filter(~F.col("multi") & (place != F.col("first"))).select("o", "c1", "c2", *ends)
    firsts = cand.filter("multi").groupBy("key", "ctx").agg(F.min(F.struct("o", "c1", "c2", "lo", "n")).alias("at"))
    again = cand.filter("multi").join(spread(firsts.select("key", "ctx", F.struct("at.o", "at.c1", "at.c2", "at.lo").alias("f"))), ["key", "ctx"])
    again = again.filter(place != F.col("f")).select("o", "c1", "c2", *ends)
    firsts = firsts.select("key", "ctx", "at.*")
    sized = firsts.join(spread(firsts.groupBy("key").agg((F.count("*") > hot).alias("hot"))), "key")
    hashed = later_windows(expand(base, sized.filter("hot"), windows_of("byte", length), WINDOW), firsts)
    parts = expand(base, sized.filter("not hot"), lambda b: _placed_segments(b, length), SEGMENT + ", o long, c1 long, c2 int, lo int")
    dealt = parts.repartition("key").sortWithinPartitions("key", "o", "c1", "c2", "lo")
    factored = dealt.mapInArrow(lambda b: _factor_blocks(b, length, (False,)), RUNS).filter("size(run_lo) > 0")
    runs_ = firsts.join(hashed.unionByName(factored), ["key", "ctx"]).select("o", "c1", "c2", "lo", F.explode(F.arrays_zip("run_lo", "run_hi")).alias("r"))
    part = runs_.select("o", "c1", "c2", F.expr("lo + r.run_lo").alias("a"), F.expr("lo + r.run_hi").alias("b"))
    ranges = whole.unionByName(again).unionByName(part).groupBy("o", "c1", "c2").agg(F.collect_list("a").alias("run_lo"), F.collect_list("b").alias("run_hi"))
    found = scratch.table(spread(ranges), "removals")
    scope.close()
    return _without(base.join(found, ["o", "c1", "c2"], "left"), docs, text, length)
