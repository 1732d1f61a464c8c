"""Exact repeats of a fixed length across a corpus, without pairs of documents.

A *window* is `length` consecutive units (words or bytes) of one text.  Every
window selects one winnowed anchor, and equal windows select equal anchors at
the same offset.  The stretch covered by all windows that select one anchor
occurrence is its *context*.  So

1. anchors that occur once settle all their windows (not repeated);
2. an anchor whose occurrences all have one context settles them as repeated;
3. only anchors with several different contexts need a closer look, and there
   one occurrence of each different context is enough.

Step 3 is left to the caller (see substring.py and suffix.py).  All steps are
aggregations with map-side combination and joins that AQE may split, so a
passage found in a third of all documents does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textblocks import _SYMBOLS, Anchors, blocks, range_hashes, signed, window_hashes
OCCURRENCE = "key long, ctx long, c1 long, c2 int, lo int, n int"
LOC = F.xxhash64  # place of an occurrence: LOC("c1", "c2", "lo")
RUNS = "key long, ctx long, run_lo array<int>, run_hi array<int>"


def with_content(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds c1, c2: two independent hashes of 64 and 32 bits that together stand for the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"c1": F.xxhash64(t), "c2": F.hash(F.lit(20011), t)})


def carried(docs: DataFrame, text: str) -> DataFrame:
    """text, and row: a struct of all other columns (so no name of theirs can clash)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*rest).alias("row"), F.col(f"`{text}`").alias("text"))


def restored(out: DataFrame, docs: DataFrame, text: str, added: list[str]) -> DataFrame:
    """The columns of docs again, except those that `added` replaces, then `added`."""
    kept = [c for c in docs.columns if c not in added]
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept], *added)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows round robin.  A join right above an aggregation on its keys reuses that
    exchange and AQE cannot split it; after this it gets exchanges of its own, which AQE splits."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def units_of(block, unit: str):
    """(unit hashes, first unit of each row, end unit of each row)"""
    if unit == "byte":
        return _SYMBOLS[block.buf], block.lo, block.hi
    w = block.words()
    return w.hashes(), w.row_lo, w.row_hi


def first_of_copies(seen: set[tuple[int, int]], c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Marks rows whose text this task has not had before; copies add nothing to what their first one shows."""
    new = np.zeros(len(c1), bool)
    for i, pair in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
        if pair not in seen:
            seen.add(pair)
            new[i] = True
    return new


def occurrences(docs: DataFrame, unit: str, length: int, gram: int, order: bool = False) -> DataFrame:
    """docs(text, c1, c2) -> one row per anchor occurrence, of each different text at least once.

    order: docs also has `o`, the place of the row among all; occurrences of every row are given, with it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # no more than the rows of one input split
        for whole in batches:
            batch = whole if order else whole.filter(pa.array(first_of_copies(seen, *(whole.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))))
            c1, c2, *o = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns))
            for b in blocks(batch.column(0)):
                values, row_lo, row_hi = units_of(b, unit)
                a = Anchors(values, row_lo, row_hi, length, gram)
                if not len(a.at):
                    continue
                row, lo = a.row + b.first, (a.lo - row_lo[a.row])
                ctx = range_hashes(values, a.lo, a.hi + length, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (signed(a.key), signed(ctx), c1[row], c2[row], lo.astype(np.int32), (a.hi - a.lo + 1).astype(np.int32), *(x[row] for x in o))],
                    names=["key", "ctx", "c1", "c2", "lo", "n", "o"][: 6 + len(o)],
                )

    return docs.select("text", "c1", "c2", *["o"] * order).mapInArrow(find, OCCURRENCE + ", o long" * order)


def candidates(docs: DataFrame, unit: str, length: int, gram: int, scope: scratch.Scope) -> DataFrame:
    """Stored occurrences of anchors found at two places or more, with `multi`: their contexts differ."""
    found, path = scratch.stored(occurrences(docs, unit, length, gram), f"anchors-{unit}")
    known = (
        found.groupBy("key")
        .agg(F.min(LOC("c1", "c2", "lo")).alias("l0"), F.max(LOC("c1", "c2", "lo")).alias("l1"), F.min("ctx").alias("x0"), F.max("ctx").alias("x1"))
        .filter("l0 != l1")
        .select("key", F.expr("x0 != x1").alias("multi"))
    )
    out = scope.table(found.join(spread(known), "key"), f"candidates-{unit}")
    scratch.drop(docs.sparkSession, path)
    return out


def contexts(cand: DataFrame) -> DataFrame:
    """Different contexts of anchors that have several; `full`: the context itself occurs twice."""
    return (
        cand.filter("multi")
        .groupBy("key", "ctx")
        .agg((F.min(LOC("c1", "c2", "lo")) != F.max(LOC("c1", "c2", "lo"))).alias("full"), F.min(F.struct("c1", "c2", "lo", "n")).alias("at"))
        .select("key", "ctx", "full", "at.*")
    )


def expand(docs: DataFrame, ctxs: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Reads contexts again from their texts: make(block rows) for docs that hold a representative."""
    per_text = ctxs.groupBy("c1", "c2").agg(F.collect_list(F.struct("key", "ctx", "lo", "n", *["o"] * ("o" in ctxs.columns))).alias("want"))
    joined = docs.join(spread(per_text), ["c1", "c2"]).select("text", "want", "c1", "c2")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a text: copies lie together after the join."""
        last = None
        for batch in batches:
            if batch.num_rows:
                c1, c2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                new = np.append((c1[0], c2[0]) != last, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
                last = (c1[-1], c2[-1])
                yield batch.filter(pa.array(new))

    return joined.mapInArrow(lambda b: make(once(b)), schema)


def _wanted(batch: pa.RecordBatch, unit: str):
    """For every block: unit hashes, block, and the wanted contexts as arrays."""
    want = batch.column(1)
    sizes = np.diff(np.asarray(want.offsets)) if len(want) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = want.flatten()
    key, ctx, lo, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    for b in blocks(batch.column(0)):
        values, row_lo, _ = units_of(b, unit)
        s, e = ends[b.first], ends[b.first + b.n]
        row = np.repeat(np.arange(b.n), sizes[b.first : b.first + b.n])
        yield b, values, key[s:e], ctx[s:e], row_lo[row] + lo[s:e], n[s:e].astype(np.int64)


WINDOW = "w long, key long, ctx long, i int"


def windows_of(unit: str, length: int) -> Callable:
    """Extension by hashes: every window of a context is hashed as a whole (128 bits with its anchor's)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, key, ctx, lo, n in _wanted(batch, unit):
                if not len(key):
                    continue
                which = np.repeat(np.arange(len(key)), n)
                i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = lo[which] + i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(window_hashes(values, start, length, 1))),
                        pa.array(key[which]),
                        pa.array(ctx[which]),
                        pa.array(i.astype(np.int32)),
                    ],
                    names=["w", "key", "ctx", "i"],
                )

    return make


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def window_runs(listed: DataFrame) -> DataFrame:
    """key, ctx, i: the windows of each context as runs: RUNS."""

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for x in batch.column(2).to_pylist():
                x = np.sort(np.asarray(x, np.int32))
                cut = np.flatnonzero(np.diff(x) > 1)
                lo.append(x[np.concatenate(([0], cut + 1))])
                hi.append(x[np.concatenate((cut, [len(x) - 1]))])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lo, kind), pa.array(hi, kind)], names=["key", "ctx", "run_lo", "run_hi"])

    return listed.groupBy("key", "ctx").agg(F.collect_set("i").alias("i")).mapInArrow(to_runs, RUNS)


def shared_windows(windows: DataFrame) -> DataFrame:
    """Runs of windows that two different contexts hold."""
    twice = (
        windows.groupBy("w", "key")
        .agg(F.min("ctx").alias("x0"), F.max("ctx").alias("x1"))
        .filter("x0 != x1")
        .select("w", "key")
    )
    return window_runs(windows.join(spread(twice), ["w", "key"]))


def later_windows(windows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Runs of windows that another context, of an earlier place (firsts: key, ctx, o, c1, c2, lo), holds too."""
    placed = windows.join(spread(firsts.select("key", "ctx", F.struct("o", "c1", "c2", "lo").alias("place"))), ["key", "ctx"])
    first = placed.groupBy("w", "key").agg(F.min(F.struct("place", "i", "ctx")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("w", "key", F.col("f.ctx").alias("fctx"), F.col("f.i").alias("fi"))
    return window_runs(placed.join(spread(first), ["w", "key"]).filter("ctx != fctx or i != fi"))


def removals(docs: DataFrame, cand: DataFrame, ctxs: DataFrame, shared: DataFrame) -> DataFrame:
    """Per text (c1, c2): run_lo, run_hi of repeated window starts; copied: the whole text occurs twice."""
    whole = cand.filter("not multi").select("c1", "c2", F.col("lo").alias("a"), F.expr("lo + n - 1").alias("b"))
    full = cand.join(spread(ctxs.filter("full").select("key", "ctx")), ["key", "ctx"]).select("c1", "c2", F.col("lo").alias("a"), F.expr("lo + n - 1").alias("b"))
    single = ctxs.filter("not full").select("key", "ctx", "c1", "c2", "lo")
    part = (
        single.join(shared, ["key", "ctx"])
        .select("c1", "c2", "lo", F.explode(F.arrays_zip("run_lo", "run_hi")).alias("r"))
        .select("c1", "c2", F.expr("lo + r.run_lo").alias("a"), F.expr("lo + r.run_hi").alias("b"))
    )
    copies = docs.groupBy("c1", "c2").count().filter("count > 1").select("c1", "c2")
    ranges = whole.unionByName(full).unionByName(part).join(spread(copies), ["c1", "c2"], "left_anti")
    marked = ranges.unionByName(copies.select("c1", "c2", F.lit(-1).alias("a"), F.lit(-1).alias("b")))
    return spread(marked.groupBy("c1", "c2").agg(F.collect_list("a").alias("run_lo"), F.collect_list("b").alias("run_hi")))


def covered(n: int, length: int, run_lo, run_hi) -> np.ndarray:
    """Units of a text of n units that a repeated window covers; a run of -1 stands for all windows."""
    if n < length or run_lo is None or not len(run_lo):
        return np.zeros(n, bool)
    lo, hi = np.asarray(run_lo), np.asarray(run_hi)
    if (lo < 0).any():
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    return np.cumsum(edge[:-1]) > 0
