"""Benchmark decontamination by rare seeds and local alignment (operator 9).

1. Every n-gram of a test item is a candidate seed.  One pass counts how many documents hold each of them (summed up in
   the tasks first).  An item's rare seeds are those that occur in at most RARE times as many documents as its median
   seed, or in FEW documents, or in RARE_SHARE of all.  An item copied a thousand times has seeds that are all alike, and
   keeps all of them; of one that is copied nowhere, seeds that many documents hold by chance are not rare.
2. Documents meet the items whose rare seeds they hold, or of which they hold two other seeds near one diagonal; around
   each such place a Smith-Waterman alignment of words (match 2, mismatch -1, gap -1) scores the best copy, edited or not,
   as a share of the item's perfect score.  A single common seed by chance costs no alignment, and neither does a
   passage that holds too few of the item's words to reach the threshold in any order.

The test set is the stated query side: it is broadcast in blocks of at most BLOCK_WORDS words, each of which meets all
documents; the driver holds one block at a time, and documents are never shuffled.  Words are compared in lower case
without punctuation.

Defined results: null and empty texts and items match nothing, and neither do items of fewer words than
a seed has (three): so short a passage is no evidence of a copy; repeated items are separate items; ties go
to the least item id; an empty item table flags nothing; columns named as the added ones are replaced, others stay,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anyname import kept_fields, numbered
from .textblocks import Block, blocks, gram_hashes, signed

SEED_WORDS = 3
BLOCK_WORDS = 400_000
CELLS = 1 << 14
RARE, FEW, RARE_SHARE = 2, 3, 1e-5
THRESHOLD = 0.45
MATCH, MISMATCH, GAP = 2, -1, -1
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best local alignment score of two word sequences (as hashes), linear gaps."""
    h, j, best = np.zeros(len(passage) + 1, np.int64), np.arange(1, len(passage) + 1), 0
    for word in item:
        new = np.maximum(0, np.maximum(h[:-1] + np.where(passage == word, MATCH, MISMATCH), h[1:] + GAP))
        new = np.maximum(new, np.maximum.accumulate(new - GAP * j) + GAP * j)
        h[1:] = new
        best = max(best, int(new.max(initial=0)))
    return best


def align_many(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """`align` of many pairs, those of similar passage length together."""
    out = np.zeros(len(items), np.int64)
    size = np.array([len(p) for p in passages], np.int64)
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        many = max(1, int(np.searchsorted(size[order[at:]] * np.arange(1, len(order) - at + 1), CELLS, "right")))
        mine = order[at : at + many]
        at += many
        wide, deep = int(size[mine].max()), max(len(items[i]) for i in mine)
        text, inside = np.zeros((len(mine), wide), np.uint64), np.arange(wide) < size[mine][:, None]
        words, long = np.zeros((len(mine), deep), np.uint64), np.array([len(items[i]) for i in mine])
        for k, i in enumerate(mine):
            text[k, : size[i]], words[k, : long[k]] = passages[i], items[i]
        h, j, best = np.zeros((len(mine), wide + 1), np.int32), np.arange(1, wide + 1, dtype=np.int32), np.zeros(len(mine), np.int32)
        for k in range(deep):  # cells beyond an item or a passage are mismatches and never the best
            same = (text == words[:, k, None]) & inside & (k < long)[:, None]
            new = np.maximum(0, np.maximum(h[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), h[:, 1:] + np.int32(GAP)))
            h[:, 1:] = np.maximum(new, np.maximum.accumulate(new - GAP * j, axis=1) + GAP * j)
            np.maximum(best, h.max(axis=1), out=best)
        out[mine] = best
    return out


class Items:
    """A block of test items: word hashes, and where each seed stands in which item."""

    def __init__(self, ids: list, texts: list[str | None], size: int):
        self.ids, self.size = ids, size
        self.words: list[np.ndarray] = []
        seed, item, place = [], [], []
        for block in blocks(pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))):
            w = block.words(_APART)
            values = w.hashes()
            for i in range(block.n):
                mine = values[w.row_lo[i] : w.row_hi[i]]
                if len(mine) >= size:
                    grams = gram_hashes(mine, size)
                    seed.append(grams)
                    item.append(np.full(len(grams), len(self.words)))
                    place.append(np.arange(len(grams)))
                self.words.append(mine)
        none = [np.zeros(0, np.int64)]
        self.seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
        self.item, self.place = np.concatenate(item or none), np.concatenate(place or none)
        self.index()

    def index(self) -> None:
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.place = self.seed[order], self.item[order], self.place[order]
        self.keys, first = np.unique(self.seed, return_index=True)
        self.first = np.append(first, len(self.seed))
        bits = max(16, int(len(self.keys) * 8).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.keys & self.mask] = True
        self.rare = np.ones(len(self.seed), bool)

    def choose(self, held: np.ndarray, documents: int) -> None:
        """Marks the rare seeds of every item; held: documents that hold each key."""
        df = np.repeat(held, np.diff(self.first))
        self.rare = np.zeros(len(df), bool)
        by_item = np.argsort(self.item, kind="stable")
        for mine in np.split(by_item, np.flatnonzero(np.diff(self.item[by_item])) + 1) if len(df) else []:
            bound = max(RARE * np.median(df[mine]), FEW, RARE_SHARE * documents)
            self.rare[mine] = (df[mine] > 0) & (df[mine] <= bound)

    def held(self, block: Block) -> np.ndarray:
        """Documents of a block that hold each key."""
        _, _, row, _, k = self.hits(block)
        once = np.unique(row * len(self.keys) + k) % max(1, len(self.keys))
        return np.bincount(once, minlength=len(self.keys))

    def hits(self, block: Block):
        """Word hashes of a block, and (row, word place in row, index of the seed in keys) of every seed in it."""
        w = block.words(_APART)
        values, none = w.hashes(), np.zeros(0, np.int64)
        if len(values) < self.size or not len(self.keys):
            return w, values, none, none, none
        grams = gram_hashes(values, self.size)
        at = np.flatnonzero(self.maybe[grams & self.mask])
        row = np.searchsorted(w.row_hi, at, "right")
        inside = at + self.size <= w.row_hi[row]
        at, row = at[inside], row[inside]
        k = np.searchsorted(self.keys, grams[at])
        true = self.keys[np.minimum(k, len(self.keys) - 1)] == grams[at]
        at, row, k = at[true], row[true], k[true]
        return w, values, row, at - w.row_lo[row], k

    def matches(self, block: Block, least: float = 0.0) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, score, aligned score) of every document and item with a passage that may score `least`.

        An alignment matches no more words of the item than the passage holds at all, so a passage with fewer is left."""
        w, values, row, at, k = self.hits(block)
        n = self.first[k + 1] - self.first[k]
        hit = np.repeat(np.arange(len(k)), n)
        entry = self.first[k][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        row, item, diagonal = row[hit], self.item[entry], at[hit] - self.place[entry]
        order = np.lexsort((diagonal, item, row))
        row, item, diagonal, rare, place = row[order], item[order], diagonal[order], self.rare[entry][order], self.place[entry][order]
        cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else []
        pairs, part, own, text = [], [], [], []
        for a, b in zip(cut, np.append(cut[1:], len(row)) if len(row) else [], strict=True):
            r, i = int(row[a]), int(item[a])
            mine, whole = self.words[i], values[w.row_lo[r] : w.row_hi[r]]
            slack, d = len(mine) // 4 + 2, diagonal[a:b]
            parts = np.flatnonzero(np.diff(d) > len(mine) + 2 * slack)
            known = len(part)
            for x, y in zip(np.append(0, parts + 1), np.append(parts, len(d) - 1), strict=True):
                near = (np.diff(d[x : y + 1]) <= slack) & (np.diff(place[a + x : a + y + 1]) != 0)
                if not rare[a + x : a + y + 1].any() and not near.any():
                    continue  # common seeds, each alone
                passage = whole[max(0, d[x] - slack) : d[y] + len(mine) + slack]
                if np.isin(mine, passage).sum() < least * len(mine) - 1e-9:
                    continue
                part.append(len(pairs))
                own.append(mine)
                text.append(passage)
            if len(part) > known:
                pairs.append((r, i))
        best = np.zeros(len(pairs), np.int64)
        np.maximum.at(best, np.array(part, np.int64), align_many(own, text))
        for (r, i), top in zip(pairs, best.tolist(), strict=True):
            yield r, i, top / (MATCH * len(self.words[i])), top


def item_blocks(items: DataFrame, id_col: str, text: str, size: int) -> Iterator[Items]:
    """Test items in blocks that the driver can hold, by a hash of their id."""
    words = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-words // (4 * BLOCK_WORDS)))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64(id_col), F.lit(n)) == k).select(id_col, text).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0]))
        yield Items([r[0] for r in rows], [r[1] for r in rows], size)


def rarity(docs: DataFrame, items: Items, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each seed of a block of items, and all documents; tasks send sums, one row a seed that occurs."""
    spread = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = spread.value
        total, rows = np.zeros(len(mine.keys), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for block in blocks(pc.utf8_lower(batch.column(0))):
                total += mine.held(block)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["k", "n"])

    out = np.zeros(len(items.keys) + 1, np.int64)  # the last one: rows
    plain = numbered(docs)
    for k, n in plain[0].select(plain[1][text]).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():  # seeds of a block
        out[k] = n
    spread.destroy()
    return out[:-1], int(out[-1])


def contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", threshold: float = THRESHOLD, least_words: int = 8, size: int = SEED_WORDS) -> DataFrame:
    """Adds best_item, best_score (0 where no passage can reach the threshold), n_items (items at the threshold) and contaminated."""
    kept, spark = kept_fields(docs, ADDED), docs.sparkSession
    plain = numbered(docs)[0].select(*[f"c{docs.columns.index(f.name)}" for f in kept])
    kind = items.schema[item_id].dataType
    out = plain.withColumns({"best#": F.lit(None).cast(kind), "score#": F.lit(0.0), "n#": F.lit(0)})
    at = [f.name for f in kept].index(text)
    for block in item_blocks(items, item_id, item_text, size):
        if len(block.keys):
            block.choose(*rarity(docs, block, text))
            out = _scan(out, spark.sparkContext.broadcast(block), at, threshold, least_words)
    return out.withColumn("hit#", F.col("n#") > 0).toDF(*[f.name for f in kept], *ADDED)


ADDED = ("best_item", "best_score", "n_items", "contaminated")


def _scan(docs: DataFrame, spread: Broadcast, at_text: int, threshold: float, least_words: int) -> DataFrame:
    at_best = len(docs.columns) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = spread.value
        for batch in batches:
            best, score, count = (batch.column(at_best + i).to_pylist() for i in range(3))
            for block in blocks(pc.utf8_lower(batch.column(at_text))):
                for r, i, s, raw in items.matches(block, threshold):
                    r += block.first
                    s = round(s, 6)
                    if s > score[r] or (s == score[r] and s > 0 and (best[r] is None or (items.ids[i] is not None and items.ids[i] < best[r]))):
                        best[r], score[r] = items.ids[i], s
                    count[r] += s >= threshold and raw >= MATCH * min(least_words, len(items.words[i]))
            columns = [*batch.columns]
            for i, x in enumerate((best, score, count)):
                columns[at_best + i] = pa.array(x, batch.schema.field(at_best + i).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without a copy of a test item, columns as they were."""
    width = len(docs.columns)
    plain, new = numbered(docs)
    text = options.pop("text", "text")
    return contaminated(plain, items, text=new[text], **options).filter(~F.col("contaminated")).select(*plain.columns).toDF(*docs.columns[:width])
