"""Near-duplicate documents by weighted minwise signatures of word shingles (operator 5).

A document is the multiset of its five-word shingles.  A shingle of weight w owns
the points of a Poisson process on [0, w) x time; equal shingles own equal points,
so the earliest point of each register coincides in two documents with
probability sum(min w) / sum(max w): the weighted Jaccard similarity.

The weight axis is cut into dyadic blocks [0,1), [1,2), [2,4), ...  A shingle draws
from each block that its weight reaches, at the block's rate, and drops points
above its weight.  Only points up to a time limit are drawn (all registers are
filled by then, else the limit is doubled), so a document costs about
m (ln m + 4) points plus one draw a shingle, whatever the weights are.

Signatures are banded; a text is compared with the most central text of its buckets first,
then texts of different classes in one bucket with each other, and every comparison counts the
true multiset overlap.  See `near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .anyname import any_names
from .graph import components
from .repeats import carried, restored, spread, with_content
from .textblocks import Block, blocks, mix64, range_hashes, signed

SHINGLE = 5
BANDS, ROWS = 32, 5
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 17
STEP = 1 << 18
_U = np.uint64


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle; a text of 1 to size-1 words is one shingle."""
    w = block.words()
    values, count = w.hashes(), w.row_hi - w.row_lo
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(block.n), n)
    lo = w.row_lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, range_hashes(values, lo, np.minimum(lo + size, w.row_hi[row]))


def bags(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the different shingles, sorted."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def signatures(row: np.ndarray, h: np.ndarray, w: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) times of the earliest points; inf for rows without shingles."""
    sig = np.full(n_rows * m, np.inf)
    total = np.bincount(row, weights=w, minlength=n_rows)
    todo, slack = np.flatnonzero(total > 0), 4.0
    reach = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1
    node = np.repeat(np.arange(len(w)), reach)
    level = np.arange(len(node)) - np.repeat(np.cumsum(reach) - reach, reach)
    base = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(base, 1)
    key = mix64(h[node] + mix64(level.astype(np.uint64) + _U(0x51ED270B)))
    while len(todo):
        limit = np.zeros(n_rows)
        limit[todo] = m * (math.log(m) + slack) / total[todo]
        live = np.flatnonzero(limit[row[node]] > 0)
        time, j = np.zeros(len(live)), 0
        stop, owner, k = limit[row[node[live]]], row[node[live]], key[live]
        rate, lo, weight = width[live].astype(float), base[live], w[node[live]]
        while len(k):
            many = max(1, min(256, 4096 // len(k)))  # points a node at once; more where few nodes are left
            steps = (np.arange(j + 1, j + many + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :]
            j += many
            draw = mix64(k[:, None] + steps)
            wait = -np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
            wait[:, 0] += time
            at = np.cumsum(wait, axis=1)
            i, c = np.nonzero(at <= stop[:, None])
            more = mix64(draw[i, c] ^ _U(0xD6E8FEB86659FD93))
            place = lo[i] + ((more >> _U(40)).astype(np.float64) * 2.0**-24 * rate[i]).astype(np.int64)
            register = (((more & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)).astype(np.int64)
            kept = place < weight[i]
            np.minimum.at(sig, (owner[i] * m + register)[kept], at[i, c][kept])
            on = np.flatnonzero(at[:, -1] <= stop)
            time, stop, owner, k, rate, lo, weight = at[on, -1], stop[on], owner[on], k[on], rate[on], lo[on], weight[on]
        filled = np.isfinite(sig.reshape(n_rows, m)).all(axis=1)
        todo, slack = todo[~filled[todo]], slack * 2 + 4
    return sig.reshape(n_rows, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(sig), bands, rows)  # coarser: the last bits of log() may differ between machines
    out = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64) + _U(0x3C6EF372)), (len(sig), bands)).copy()
    for i in range(rows):
        out = mix64(out * _U(0xFF51AFD7ED558CCD) + bits[:, :, i])
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """One byte of each register: equal registers have equal bytes."""
    return (mix64(sig.astype(np.float32).view(np.uint32).astype(np.uint64)) & _U(0xFF)).astype(np.uint8)


def signed_texts(base: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """One row per different text with words: v (its number), c1 and c2 (its 96-bit hash), n shingles, band keys, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                row, h = shingles(b, size)
                row, h, w = bags(row, h)
                n = np.bincount(row, weights=w, minlength=b.n).astype(np.int64)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                sig = signatures(row, h, w, b.n, bands * rows)[full]
                keys, small = band_keys(sig, bands, rows), sketches(sig)
                flat = pa.array(signed(keys.reshape(-1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), flat)
                at = pa.array(full + b.first)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(n[full]), lists, pa.array([x.tobytes() for x in small], pa.binary())], names=["c1", "c2", "n", "bands", "sketch"])

    found = base.select("text", "c1", "c2").mapInArrow(sign, "c1 long, c2 int, n long, bands array<long>, sketch binary")
    one = found.groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    return one.withColumn("v", F.monotonically_increasing_id())  # fixed by the table it is written to


def in_shared_buckets(signs: DataFrame) -> DataFrame:
    """Signed texts that share a bucket, with those buckets and rank: the centre of a family shares more, and larger,
    buckets than its other members and has the least."""
    member = signs.select("v", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = member.join(spread(shared), "bucket").groupBy("v").agg((-F.sum("k")).alias("rank"), F.collect_list("bucket").alias("buckets"))
    return met.join(signs, "v")


def central_pairs(held: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every text and the most central pivot (least rank) of its buckets, where lengths allow the threshold."""
    at = held.select("v", "rank", "n", F.explode("buckets").alias("bucket"))
    pivots = at.groupBy("bucket").agg(F.min(F.struct("rank", "v", "n")).alias("p"))
    fits = F.least("n", "p.n") >= threshold * F.greatest("n", "p.n") - 1e-9
    met = at.join(spread(pivots), "bucket").filter((F.col("v") != F.col("p.v")) & fits)
    return met.groupBy("v").agg(F.min(F.struct("p.rank", "p.v")).alias("p")).select(F.col("v").alias("a"), F.col("p.v").alias("b"))


def overlaps(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """pairs(a, b) of different texts, texts(v, text) -> pairs whose weighted Jaccard similarity reaches the threshold."""
    left, right = (texts.select(F.col("v").alias(s), F.col("text").alias(f"t{s}")) for s in "ab")
    joined = pairs.join(left, "a").join(right, "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for x in blocks(batch.column(0)):
                (y,) = blocks(batch.column(1).slice(x.first, x.n), 1 << 62)
                left, right = bags(*shingles(x, size)), bags(*shingles(y, size))
                a_cut, b_cut = np.searchsorted(left[0], np.arange(x.n + 1)), np.searchsorted(right[0], np.arange(x.n + 1))
                for i in range(x.n):
                    a, b = slice(a_cut[i], a_cut[i + 1]), slice(b_cut[i], b_cut[i + 1])
                    _, p, q = np.intersect1d(left[1][a], right[1][b], assume_unique=True, return_indices=True)
                    inter = int(np.minimum(left[2][a][p], right[2][b][q]).sum())
                    union = int(left[2][a].sum() + right[2][b].sum()) - inter
                    keep[x.first + i] = union > 0 and inter >= threshold * union - 1e-9
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at)], names=["a", "b"])

    return joined.select("ta", "tb", "a", "b").mapInArrow(verify, "a long, b long")


def in_blocks(rest: DataFrame, texts: int, shingle: int) -> DataFrame:
    """rest(bucket, v, c, n, ...) -> for every two blocks of a bucket (i, j), their rows; `mine` is the row's block.

    Buckets with one class only have no rows.  A large bucket is dealt into blocks of about `texts` texts or
    `shingle` shingles by a hash of the text; its largest class has blocks of its own, which need not meet each other."""
    per_class = rest.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    size = per_class.groupBy("bucket").agg(F.max(F.struct("k", "s", "c")).alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    count = lambda k, s: F.ceil(F.greatest(k / texts, s / shingle)).cast("int")
    small = (F.col("k") <= texts) & (F.col("s") <= shingle)
    few = F.when(small, 1).otherwise(count(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")))
    size = size.select("bucket", F.when(~small, F.col("top.c")).alias("main"), few.alias("few"), count(F.col("top.k"), F.col("top.s")).alias("most"))
    in_main = F.coalesce(F.col("c") == F.col("main"), F.lit(False))
    deal = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    mine = F.when(in_main, F.col("few") + deal(F.col("most"))).otherwise(deal(F.col("few")))
    last = F.when(in_main | F.col("main").isNull(), F.col("few") - 1).otherwise(F.col("few") + F.col("most") - 1)
    dealt = rest.join(spread(size), "bucket").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    kept = [c for c in rest.columns if c != "bucket"]
    return dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *kept)


def grouped(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of `grouped` rows, cut again at group ends to about `most` shingles: the rows, and where groups start and end."""

    def pieces(t: pa.Table, cut: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        total = np.append(0, np.cumsum(t["n"].to_numpy()))[cut]
        at = 0
        while at < len(cut) - 1:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield t.slice(cut[at], cut[to] - cut[at]), cut[at : to + 1] - cut[at]
            at = to

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([np.diff(t[name].to_numpy()) != 0 for name in ("bucket", "i", "j")], axis=0)
        cut = np.flatnonzero(new)
        yield from pieces(t, cut)
        held = t.slice(cut[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.array([0, t.num_rows])


def rivals(t: pa.Table, cut: np.ndarray, threshold: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) and equal registers of every pair to compare: of two blocks and two classes, in the first bucket that
    both share, with lengths and sketches that allow the threshold."""
    bucket, i, j, mine, c, n = (t[name].to_numpy() for name in ("bucket", "i", "j", "mine", "c", "n"))
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    bands = t["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    later = np.repeat(cut[1:], np.diff(cut)) - np.arange(t.num_rows) - 1
    total = np.append(0, np.cumsum(later))
    out, lo = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16))], 0
    while lo < t.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + STEP, "right")) - 1)
        a = np.repeat(np.arange(lo, hi), later[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], later[lo:hi])
        keep = (c[a] != c[b]) & ((i[a] == j[a]) | (mine[a] != mine[b])) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9)
        a, b, lo = a[keep], b[keep], hi
        for at in range(0, len(a), 1 << 15):
            x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            alike = (sketch[x] == sketch[y]).sum(axis=1, dtype=np.int16)
            good = alike >= least * sketch.shape[1]
            x, y, alike = x[good], y[good], alike[good]
            first = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == bucket[x]
            out.append((x[first].astype(np.int32), y[first].astype(np.int32), alike[first]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def in_rivalry(blocks_: DataFrame, threshold: float, least: float) -> DataFrame:
    """The rows that some other row of their group is to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in whole_groups(batches, 1 << 20):
            a, b, _ = rivals(t, cut, threshold, least)
            yield from t.take(pa.array(np.union1d(a, b))).to_batches()

    return grouped(blocks_).mapInArrow(run, blocks_.schema)


def multiset(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, cut): the shingles of each text as a set of numbers, the k-th repeat of one as a number of its own."""
    parts = [(row + b.first, h) for b in blocks(column) for row, h in [shingles(b, size)]]
    row, h, w = bags(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    repeat = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    row, h = np.repeat(row, w), np.repeat(h, w)
    h = np.where(repeat > 0, mix64(h + mix64(repeat.astype(np.uint64))), h)
    return np.unique(h, return_inverse=True)[1], np.searchsorted(row, np.arange(len(column) + 1))


def shared_counts(number: np.ndarray, cut: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets (a sorted)."""
    out, mark, size = np.zeros(len(a), np.int64), np.zeros(int(number.max(initial=-1)) + 1, bool), np.diff(cut)
    edge = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
    for s, e in zip(edge, np.append(edge[1:], len(a)) if len(a) else [], strict=True):
        own = number[cut[a[s]] : cut[a[s] + 1]]
        mark[own] = True
        for lo in range(s, e, 256):
            with_ = b[lo : min(e, lo + 256)]
            start = np.cumsum(size[with_]) - size[with_]
            flat = np.repeat(cut[with_] - start, size[with_]) + np.arange(int(size[with_].sum()))
            out[lo : lo + len(with_)] = np.add.reduceat(mark[number[flat]], start, dtype=np.int64)
        mark[own] = False
    return out


def block_links(rows: DataFrame, threshold: float, least: float, size: int) -> DataFrame:
    """Compares all pairs of `rivals` that no link found in the same task has joined meanwhile, likeliest first; the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in whole_groups(batches, 1 << 18):
            a, b, alike = rivals(t, cut, threshold, least)
            if not len(a):
                continue
            order = np.argsort(-alike, kind="stable")
            a, b = a[order], b[order]
            number, ends = multiset(t["text"], size)
            n, v = np.diff(ends), t["v"].to_numpy()
            c = np.unique(t["c"].to_numpy(), return_inverse=True)[1]
            root = np.arange(int(c.max()) + 1)
            at, many, links = 0, t.num_rows, []
            while at < len(a):
                x, y = a[at : at + many], b[at : at + many]
                at, many = at + many, min(2 * many, 1 << 17)
                apart = root[c[x]] != root[c[y]]
                x, y = x[apart], y[apart]
                turn = np.argsort(x, kind="stable")
                x, y = x[turn], y[turn]
                both = shared_counts(number, ends, x, y)
                linked = both >= threshold * (n[x] + n[y] - both) - 1e-9
                x, y = x[linked], y[linked]
                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    s, r = root[c[p]], root[c[q]]
                    while root[s] != s:
                        s = root[s]
                    while root[r] != r:
                        r = root[r]
                    if r != s:
                        root[max(r, s)] = min(r, s)
                        links.append((p, q))
                while (up := root[root]).tolist() != root.tolist():
                    root = up
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(v[found[:, 0]]), pa.array(v[found[:, 1]])], names=["a", "b"])

    return grouped(rows).mapInArrow(run, "a long, b long")


@any_names("id_col", "text")
def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Every row with class_id (least id of its class), class_size, n_joins (links at its text that joined classes, see below) and class_key.

    1. Every text is compared with one pivot, the most central text of its buckets: one pair a text, however large a
       family is.  Texts with the same pivot are one class from here on.
    2. In every bucket, texts of different classes are compared in blocks (`in_blocks`), each pair in the first bucket
       that it shares and unless links found in that task already join it.

    So any two texts that share a bucket have been compared or are joined by links.  Comparisons whose sketches are 4.5
    standard deviations below the threshold are skipped; links within one class change nothing and are not looked for.

    Equal texts (96 bits of hash) are one vertex.  Texts without words (null and empty alike) join only equal
    texts.  A null id never becomes the class id unless the class has no other.  Ties and repeated
    rows share their class.  Columns of the names added here are replaced; an empty table gives no rows."""
    scope = scratch.Scope(docs.sparkSession)
    base = with_content(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text")
    signs = scope.table(signed_texts(base, bands, rows, size), "signatures")
    held = scope.table(in_shared_buckets(signs), "members")
    # copies of a text that a third of all rows may be are collapsed in each task before they are shuffled
    copies = scope.table(base.join(spread(held.select("c1", "c2", "v")).hint("merge"), ["c1", "c2"]).select("v", "text"), "copies")
    texts = scope.table(copies.groupBy("v").agg(F.first("text").alias("text")), "texts")
    least = threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / (bands * rows))

    starred = scope.table(overlaps(scope.table(central_pairs(held, threshold), "pairs"), texts, threshold, size), "links")
    hop = starred.select(F.col("a").alias("b"), F.col("b").alias("top"))
    label = starred.join(hop, "b", "left").select(F.col("a").alias("v"), F.coalesce("top", "b").alias("c"))
    others = held.select("v", "n", "sketch", "bands", F.explode("buckets").alias("bucket")).join(spread(label), "v", "left").withColumn("c", F.coalesce("c", "v"))
    others = scope.table(others, "buckets")
    rivals_ = scope.table(in_rivalry(in_blocks(others, BLOCK_TEXTS, BLOCK_SHINGLES), threshold, least), "rivals")
    found = scope.table(block_links(rivals_.join(texts, "v"), threshold, least, size), "links")

    edges = starred.unionByName(found)
    ends = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n_joins"))
    named = components(edges).join(ends, "v").join(signs.select("v", "c1", "c2"), "v").select("c1", "c2", "c", "n_joins")
    vertex = base.groupBy("c1", "c2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    vertex = scope.table(vertex.join(spread(named), ["c1", "c2"], "left"), "vertices")
    classes = vertex.filter("c is not null").groupBy("c").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    alone = vertex.filter("c is null").select("c1", "c2", F.col("least").alias("class_id"), F.col("copies").alias("class_size"), F.lit(0).cast("long").alias("n_joins"), F.struct("c1", F.col("c2").cast("long").alias("c2")).alias("class_key"))
    joined = vertex.filter("c is not null").join(spread(classes), "c").select("c1", "c2", "class_id", "class_size", "n_joins", F.struct(F.col("c").alias("c1"), F.lit(-1).cast("long").alias("c2")).alias("class_key"))
    per_text = scratch.table(alone.unionByName(joined), "classes")
    scope.close()
    held_rows = with_content(carried(docs, text))
    return restored(held_rows.join(spread(per_text), ["c1", "c2"]), docs, text, ["class_id", "class_size", "n_joins", "class_key"])


@any_names("id_col", "text")
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, columns as they were: the one with the least id, of rows that share it the one with the
    least text (null first); rows alike in both are one document, and any of them stays."""
    found = near_duplicates(docs, id_col=id_col, text=text, **options).filter(F.col(id_col).eqNullSafe(F.col("class_id")))
    twice = found.groupBy("class_key", id_col).count().filter("count > 1").limit(1).count()
    if twice:
        least = F.struct(F.col(text).isNotNull(), F.col(text))
        found = found.groupBy("class_key", F.col(id_col).alias("id#")).agg(F.min_by(F.struct(*docs.columns), least).alias("row#")).select("row#.*")
    return found.select(*docs.columns)
