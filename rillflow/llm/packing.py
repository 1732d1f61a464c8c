"""Mixture-controlled packing by deficit round robin in closed form (operator 8).

Every source is a queue: the token stream of its documents.  Round robin with
carried deficits gives source s, after t windows, the tokens whose virtual time
(i + 1/2) / w_s is among the window * t smallest of all queues (w_s: target
share; ties go to the first queue).  That count C_s(t) is a function of t, the
shares and the queue lengths alone, so any task can tell where a document is cut
without knowing what other tasks do: deficits carry over windows and partitions
by construction.  Each window holds C_s(t+1) - C_s(t) tokens of source s, within
one token of its target; a queue that runs dry leaves its share to the others.

Steps: tokens are written once with their place in their partition's queues;
totals per (partition, queue) give global places; documents are then cut in the
order stored.  Token rows are joined with those places by broadcast while that table is
small, so they are not shuffled.  Counts are worked out for the edges of the windows that a batch touches, so memory
follows CELLS, not pieces times queues.

Defined results: null text is empty (one end token); sources beyond the
`max_queues` largest (a window cannot hold tokens of more sources than it has tokens) share
one queue, whose share is the sum of theirs, and take turns in it by a second round robin of as many queues, each
with the sources of one hash; a null source is a queue of its own; ties
and repeated rows are packed like any other row; an empty table gives no rows; other
columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch
from .textblocks import _SYMBOLS, Block, blocks, range_hashes

CACHE_UNITS = 250_000
MAX_QUEUES = 1024
BLOCK = 1 << 20
CELLS = 1 << 19
_encoders: dict[str, Encoder] = {}

# Kinds of bytes: 0 white space, 1 ASCII letter, 2 other ASCII sign, 3 apostrophe or part of another character.
_KIND = np.full(256, 3, np.uint8)
_KIND[:128] = 2
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x27] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def byte_signs() -> dict[int, int]:
    """How byte-level tokenizers write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {x: 256 + i for i, x in enumerate(rest)}


def pack_ids(*ids: int) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of whole texts, unit by unit, units remembered.

    The tokenizers that this is for fold case, drop white space and split between letters, digits and signs
    before they merge, so a text's ids are those of its units: runs of bytes cut at ASCII white space and
    between an ASCII letter and another ASCII sign but the apostrophe.  A unit of letters goes to the merges
    directly, any other through the whole tokenizer; a text that spells a special token is encoded as a whole.
    The tests compare with whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.signs = self.tokenizer.model.tokenize, byte_signs()
        self.known: dict[bytes, bytes] = {}

    def learn(self, units: list[bytes]) -> None:
        merge, known, odd = self.merge, self.known, []
        for unit in units:
            if unit.isalpha():  # ASCII letters, lower case by now
                word = unit.decode()
            else:
                word = unit.decode("utf-8", "replace")
                low = word.lower()
                if not word.isalpha() or not low.isalpha() or max(word) >= "\u0250":
                    odd.append((unit, word))
                    continue
                word = low.encode().decode("latin-1").translate(self.signs)
            known[unit] = pack_ids(*[t.id for t in merge(word)])
        for (unit, _), got in zip(odd, self.tokenizer.encode_batch_fast([w for _, w in odd], add_special_tokens=False), strict=True):
            known[unit] = pack_ids(*got.ids)

    def units(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[b.buf]
        inside = kind > 0
        start = inside.copy()
        start[1:] &= ~inside[:-1] | ((kind[1:] ^ kind[:-1]) == 3)
        full = b.hi > b.lo
        first, last = b.lo[full], b.hi[full] - 1
        start[first] = inside[first]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | start[1:]
        stop[last] = inside[last]
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of each row's ids)"""
        b = Block(_LOWER[b.buf], b.lo, b.hi, b.first)
        lo, hi = self.units(b)
        if not len(lo):
            return np.zeros(0, np.uint32), np.zeros(b.n, np.int64)
        _, at, which = np.unique(range_hashes_of_bytes(b.buf, lo, hi), return_index=True, return_inverse=True)
        raw = b.buf.tobytes()
        found = [raw[s:e] for s, e in zip(lo[at].tolist(), hi[at].tolist(), strict=True)]
        if len(self.known) > CACHE_UNITS:  # short units come again
            self.known = {k: v for k, v in self.known.items() if len(k) <= 7}
            if len(self.known) > CACHE_UNITS // 2:
                self.known.clear()
        self.learn([x for x in found if x not in self.known])
        parts = [self.known[x] for x in found]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begin, n = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size, size[which]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(lo, b.hi)] - ends[np.searchsorted(lo, b.lo)]

    def encode_rows(self, b: Block, end: int) -> tuple[np.ndarray, np.ndarray]:
        """`encode` with the end id after every row."""
        ids, n = self.encode(b)
        whole = [i for i in range(b.n) if any(x in b.text(i) for x in self.special)] if any(x in b.buf.tobytes() for x in self.special) else []
        if whole:
            rows = np.split(ids, np.cumsum(n)[:-1])
            for i in whole:
                rows[i] = np.array(self.tokenizer.encode(b.text(i).decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            ids, n = np.concatenate(rows), np.array([len(x) for x in rows], np.int64)
        return np.insert(ids, np.cumsum(n), end).astype("<u4"), n + 1


def range_hashes_of_bytes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return range_hashes(_SYMBOLS[buf], lo, hi)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_array(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary array of rows of n ids."""
    ends = pa.py_buffer(np.append(0, 4 * np.cumsum(n)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(np.ascontiguousarray(ids))])


class Plan:
    """Cumulative allocation C_s(t); few numbers, sent along with the tasks."""

    def __init__(self, lengths: list[int], shares: list[float], window: int):
        if len(lengths) > window:
            raise ValueError("more queues than a window has tokens")
        self.n, self.window = np.array(lengths, np.int64), window
        w = np.array(shares, float)
        self.w = w / w.sum() if len(w) else w
        self.total = int(self.n.sum())
        ends = np.unique(np.append(self.n / self.w, 0.0)) if len(w) else np.zeros(1)
        self.times, self.filled = ends, np.array([np.minimum(self.n, self.w * v).sum() for v in ends])

    def window_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Window of a queue's token, to within one."""
        return (np.interp((place + 0.5) / self.w[queue], self.times, self.filled) // self.window).astype(np.int64)

    def allocated(self, t: np.ndarray) -> np.ndarray:
        """C_s(t) for all t: an array (len(t), queues).

        A count that is certainly not too high is raised by whole rounds: of the queues' next tokens all that come
        before any queue's next but one are safe to take, in order of time, then queue."""
        goal = np.minimum(np.maximum(t, 0) * self.window, self.total)
        counted = lambda v, w, n: np.minimum(n, np.floor(np.maximum(w * v[:, None], 0.0) + 0.5)).astype(np.int64)
        v = np.interp(goal, self.filled, self.times) * (1 - 1e-12)
        got = counted(v, self.w, self.n)
        short = goal - got.sum(axis=1)
        free = lambda c: np.maximum((self.w * (c < self.n)).sum(axis=1), self.w.min(initial=1.0) / 2)
        while len(rows := np.flatnonzero(short < 0)):
            v[rows] += (short[rows] - 1) / np.maximum(self.w.sum(), 1e-300)
            got[rows] = counted(v[rows], self.w, self.n)
            short[rows] = goal[rows] - got[rows].sum(axis=1)
        for _ in range(4):  # nearly all of what is missing, at once
            rows = np.flatnonzero(short > 8)
            if not len(rows):
                break
            step = (short[rows] - np.sqrt(len(self.n)) / 2) / free(got[rows])
            tried = v[rows] + np.maximum(step, 0.0)
            more = counted(tried, self.w, self.n)
            missing = goal[rows] - more.sum(axis=1)
            fits = missing >= 0
            v[rows[fits]], got[rows[fits]], short[rows[fits]] = tried[fits], more[fits], missing[fits]
        while len(rows := np.flatnonzero(short > 0)):
            here, need = got[rows], short[rows]
            following = np.where(here < self.n, (here + 0.5) / self.w, np.inf)
            second = np.where(here + 1 < self.n, (here + 1.5) / self.w, np.inf).min(axis=1)
            safe = np.where(following < second[:, None], following, np.inf)
            many = np.isfinite(safe).sum(axis=1)
            all_ = many <= need
            here[all_] += np.isfinite(safe[all_])
            some = np.flatnonzero(~all_)
            if len(some):
                order = np.argsort(safe[some], axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
                here[some] += place < need[some, None]
            got[rows], short[rows] = here, goal[rows] - here.sum(axis=1)
        return got

    def cut(self, queue: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents at `place` of their queues: document, start, length, window, offset there.

        Counts at a window's edges are worked out for all queues at once, CELLS of them at a time; a piece keeps those of
        its own queue and the sum of those before it."""
        first = np.maximum(self.window_of(queue, place) - 2, 0)
        count = self.window_of(queue, place + n - 1) + 3 - first
        doc = np.repeat(np.arange(len(n)), count)
        t = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        edge, at = np.unique(np.concatenate((t, t + 1)), return_inverse=True)
        q = np.tile(queue[doc], 2)
        own, below = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        order, step = np.argsort(at, kind="stable"), max(1, CELLS // max(1, len(self.n)))
        ends = np.searchsorted(at[order], np.arange(0, len(edge) + step, step))
        for k, i in enumerate(range(0, len(edge), step)):
            mine = order[ends[k] : ends[k + 1]]
            c = self.allocated(edge[i : i + step])
            own[mine] = c[at[mine] - i, q[mine]]
            below[mine] = (np.cumsum(c, axis=1) - c)[at[mine] - i, q[mine]]
        m = len(t)
        before, after, ahead = own[:m], own[m:], below[m:] - below[:m]
        lo, hi = np.maximum(place[doc], before), np.minimum(place[doc] + n[doc], after)
        keep = hi > lo
        return doc[keep], (lo - place[doc])[keep], (hi - lo)[keep], t[keep], (ahead + lo - before)[keep]


def cut_nested(outer: Plan, inner: Plan, shared: int, queue: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """`Plan.cut` where queues from `shared` on are those of the inner plan, whose windows one after another are the
    outer plan's queue of that number."""
    doc, start, size = np.arange(len(n)), np.zeros(len(n), np.int64), n
    small = queue >= shared
    if small.any():
        d, a, k, t, offset = inner.cut(queue[small] - shared, place[small], n[small])
        big = np.flatnonzero(~small)
        doc, start, size = np.concatenate((big, np.flatnonzero(small)[d])), np.concatenate((start[big], a)), np.concatenate((n[big], k))
        place, queue = np.concatenate((place[big], t * inner.window + offset)), np.concatenate((queue[big], np.full(len(d), shared)))
    piece, a, k, t, offset = outer.cut(queue, place, size)
    return doc[piece], start[piece] + a, k, t, offset


def tokenized(docs: DataFrame, path: str, end_id: int, text: str, id_col: str, queue: str) -> DataFrame:
    """id, queue, part, place (in this partition's queue), n and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), {}, encoder(path)
        for batch in batches:
            for b in blocks(batch.column(1), BLOCK):
                mine = batch.slice(b.first, b.n)
                ids, n = enc.encode_rows(b, end_id)
                place = []
                for q, k in zip(mine.column(2).to_pylist(), n.tolist(), strict=True):
                    place.append(seen.get(q, 0))
                    seen[q] = place[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [mine.column(0), mine.column(2), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64()), pa.array(n), ids_array(ids, n)],
                    names=["id", "queue", "part", "place", "n", "ids"],
                )
        enc.known.clear()  # the worker goes on to other work

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(queue).alias("queue")).mapInArrow(run, f"id {kind}, queue int, part int, place long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, source: str = "source", text: str = "text", id_col: str = "doc_id", window: int = 2048, end_id: int = 1, shares: dict[str, float] | None = None, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    shares: target share of tokens by source; default: the shares that the corpus has."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    most = min(max_queues, window - 1)
    sized = docs.groupBy(name.alias("s")).count().orderBy(F.desc("count"), "s").limit(most).collect()
    number = {r["s"]: i for i, r in enumerate(sized)}
    pairs = [x for s, i in number.items() for x in (F.lit(s), F.lit(i))]
    small = F.lit(most) + F.pmod(F.xxhash64(name), F.lit(most)).cast("int")
    queue = F.coalesce(F.element_at(F.create_map(*pairs), name), small) if pairs else small
    tokens = scratch.table(tokenized(docs.withColumn("queue#", queue), tokenizer, end_id, text, id_col, "queue#"), "tokens")
    held = scratch.table(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "held")
    totals = {r["queue"]: r["n"] for r in held.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row a queue
    direct, rest = sorted(q for q in totals if q < most), sorted(q for q in totals if q >= most)
    wanted: dict[str | int, float] = {}
    for s, x in (shares or {}).items():  # sources that share a queue add up
        q = number.get("=" + s, most)
        wanted[q] = wanted.get(q, 0.0) + x
    lengths = [totals[q] for q in direct] + ([sum(totals[q] for q in rest)] if rest else [])
    plan = Plan(lengths, [wanted.get(q, n if not shares else 1e-9) for q, n in zip([*direct, most], lengths, strict=False)], window)
    inner = Plan([totals[q] for q in rest], [totals[q] for q in rest], window)
    rank = {q: i for i, q in enumerate([*direct, *rest])}
    shared = len(direct)
    ahead = held.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # read from files, its size is known: Spark broadcasts it below spark.sql.autoBroadcastJoinThreshold and shuffles beyond
    ahead = scratch.table(ahead, "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                q = np.array([rank[x] for x in batch.column(1).to_pylist()], np.int64)
                n, place = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                doc, start, length, t, offset = cut_nested(plan, inner, shared, q, place, n)
                _, ends, raw = batch.column(4).buffers()
                begin = np.frombuffer(ends, np.int32)[batch.column(4).offset :][: batch.num_rows].astype(np.int64) // 4
                ids, first = np.frombuffer(raw, "<u4"), np.cumsum(length) - length
                pieces = ids[np.repeat(begin[doc] + start - first, length) + np.arange(int(length.sum()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), ids_array(pieces, length), pa.array(n[doc]), pa.array(t), pa.array(offset)],
                    names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    kind = tokens.schema["id"].dataType.simpleString()
    placed = tokens.join(ahead, ["queue", "part"]).select("id", "queue", "n", (F.col("place") + F.col("ahead")).alias("place"), "ids")
    out = placed.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
