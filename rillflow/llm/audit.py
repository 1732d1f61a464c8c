"""Filter interaction audit (operator 12).

Five filters A to E are judged on every row; the rows of a part that fail one same set of filters are a cell of a
vector of 32 counts, and every order of the filters follows from that vector alone.

E (a copy of a smaller id's text) is found by routing: each task keeps, for every xxhash of a text, a chain of the
different texts with that hash and the smallest id of each.  A row that is not the smallest of its text in its own
task is settled there and leaves its text behind, so of a text with any number of copies each task ships one.  What is
left is dealt by xxhash, and the same chains settle it.  Chains of the first step hold at most `chain_bytes` of text;
beyond that the minima are shipped early, which changes no result.  Settled rows are ids and masks of five bits;
`combineByKey` merges them into vectors of counts, and only these vectors come together.

Defined results: a null text is empty, a null language is the part ""; a row without id is no copy and makes no other
row one; rows that share an id count as often as they occur, and none of them is a copy of another; equal texts of
three and more ids leave the smallest; a doc_id with several labels is good, or toxic, if one label says so; labels of
unknown ids are ignored; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count, permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
ORDERS = tuple("".join(p) for p in permutations(LETTERS))
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

Row = tuple[int | None, str, int, int]  # id, part, mask of failed filters, rows
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


def own_mask(text: bytes) -> int:
    """Filters A to D of a text in UTF-8; bytes.split() parts at the six ASCII blanks and no other."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.decode("utf-8")) if not text.isascii() else len(text)
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, _SIGNS)) < len(text)) << 3


class Chains:
    """Different texts by hash, each with its smallest id, the filters it fails and that id's rows by part."""

    def __init__(self, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        self.digest, self.chains, self.bytes = digest, {}, 0

    def add(self, text: bytes, i: int, mask: int, parts: dict[str, int]) -> Iterator[Row]:
        """Rows that are settled now: of two ids with one text, those of the larger."""
        chain = self.chains.setdefault(self.digest(text), [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            chain.append([text, i, mask, parts])
            self.bytes += len(text)
        elif i == link[1]:  # rows of one id: none is a copy of the other
            for part, n in parts.items():
                link[3][part] = link[3].get(part, 0) + n
        else:
            if i < link[1]:
                i, link[1], parts, link[3] = link[1], i, link[3], parts
            for part, n in parts.items():
                yield i, part, mask | COPY, n

    def drain(self) -> Iterator[tuple[int, tuple[bytes, int, int, dict[str, int]]]]:
        """(hash, link) of all that is held."""
        for digest, chain in self.chains.items():
            for link in chain:
                yield digest, tuple(link)
        self.chains, self.bytes = {}, 0


def failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang", chain_bytes: int = 1 << 26) -> RDD:
    """(id, part, mask, rows) of all rows.

    The bytes of all texts are summed first: the chains of a task of the second step then hold half of `chain_bytes` on
    average, however well the input is compressed."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).rdd

    def locally(batch: Iterable) -> Iterator[tuple[int, tuple]]:
        chains, spread = Chains(), count()  # settled rows go to any task
        for i, group, data in batch:
            data = bytes(data)
            mask = own_mask(data)
            if i is None:
                yield next(spread), (None, group, mask, 1)
                continue
            for row in chains.add(data, i, mask, {group: 1}):
                yield next(spread), row
            if chains.bytes > chain_bytes:
                yield from chains.drain()
        yield from chains.drain()

    def finally_(batch: Iterable[tuple[int, tuple]]) -> Iterator[Row]:
        chains = Chains()
        for _, held in batch:
            if isinstance(held[0], bytes):
                yield from chains.add(*held)
            else:
                yield held
        for _, (_, i, mask, parts) in chains.drain():
            for part, n in parts.items():
                yield i, part, mask, n

    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(2 * total // max(1, chain_bytes) + 1, shuffled)
    return rows.mapPartitions(locally).partitionBy(pieces, lambda digest: digest).mapPartitions(finally_)


def _vector(value: tuple[int, int, int, int]) -> np.ndarray:
    return _counted(np.zeros((3, 1 << len(LETTERS)), np.int64), value)


def _counted(vector: np.ndarray, value: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = value
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def interactions(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """Rows of all orders and steps from the counts by mask: of all rows, of good ones, of toxic ones."""
    masks = np.arange(vector.shape[1])
    size = np.array([int(m).bit_count() for m in masks])
    alone, shares = {}, {}
    for i, letter in enumerate(LETTERS):
        mine = (masks >> i & 1) == 1
        alone[letter] = int(vector[0, 1 << i])
        shares[letter] = int((vector[0, mine] * (len(ORDERS) // size[mine])).sum())  # first of its mask in 120 / size orders
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, gone = (masks & bit) > 0, (masks & before) > 0
            removed, good, toxic = (int(x) for x in vector[:, fails & ~gone].sum(axis=1))
            before |= bit
            yield part, order, step, int(vector[0, (masks & before) == 0].sum()), removed, int(vector[0, fails & gone].sum()), alone[letter], good, toxic, shares[letter]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = docs.sparkSession
    settled = spark.createDataFrame(failures(docs, id_col, text, part), "id long, part string, mask int, n long", verifySchema=False)
    rows = settled.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks.filter("id is not null"), "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _counted, np.add)
    return spark.createDataFrame(vectors.flatMap(lambda kv: interactions(*kv)), RESULT, verifySchema=False)
