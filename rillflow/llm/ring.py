"""Consistent hashing with virtual nodes and bounded loads (operator 2, DataFrame functions only).

The ring has equal cells (16,384 for up to 25 shards, four for each virtual node beyond).  Each shard owns virtual nodes at hashed cells; a
row belongs to the first node at or clockwise after the cell of its key's hash.
A shard takes rows, nodes in ring order, until its capacity is reached; what is
left over goes on clockwise to the next node whose shard has room, and so on.

Only the loads of the cells (a number each, whatever the data) reach the driver,
which works out for each cell which stretch of its rows, in hash order, goes to
which shard.  That table is broadcast up to BROADCAST_STRETCHES rows, and joined by a shuffle beyond.

Defined results: null text has 0 bytes; rows with equal ids are told apart by
text and size; fully equal rows are interchangeable; an empty table gives no rows; other columns are
not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

CELL_BITS = 14
NODES, MOST_NODES = 160, 1 << 16
BROADCAST_STRETCHES = 1 << 18


def sized(shards: int, nodes: int = NODES) -> tuple[int, int]:
    """(virtual nodes a shard, bits of the cell number): fewer nodes a shard where shards are many, four cells a node."""
    nodes = max(1, min(nodes, MOST_NODES // max(1, shards)))
    return nodes, max(CELL_BITS, (4 * shards * nodes - 1).bit_length())


def ring(shards: int, nodes: int, cells: int) -> tuple[list[int], list[int]]:
    """Cells of the virtual nodes in ring order, and their shards; a node whose cell is taken goes to the next free one."""
    at: dict[int, int] = {}
    for s in range(shards):
        for j in range(nodes):
            cell = int.from_bytes(hashlib.blake2b(f"{s}/{j}".encode(), digest_size=8).digest(), "big") % cells
            while cell in at:
                cell = (cell + 1) % cells
            at[cell] = s
    places = sorted(at)
    return places, [at[c] for c in places]


def stretches(loads: dict[int, int], caps: list[int], nodes: int = NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, place): loads from..to of a cell go to the shard, at that place of its load."""
    if sum(caps) < sum(loads.values()):
        raise ValueError("capacities are smaller than the load")
    nodes, bits = sized(len(caps), nodes)
    cells, owner = ring(len(caps), nodes, 1 << bits)
    room, taken, out = list(caps), [0] * len(caps), []
    onward = list(range(len(cells)))  # a node with room, or one to look at next

    def with_room(node: int) -> int:
        path = []
        while not room[owner[node]]:
            if onward[node] == node:
                onward[node] = (node + 1) % len(cells)
            path.append(node)
            node = onward[node]
        for x in path:
            onward[x] = node
        return node

    waiting = [(bisect_left(cells, c) % len(cells), c, 0, n) for c, n in sorted(loads.items()) if n]
    while waiting:
        passed = []
        for node, cell, lo, hi in sorted(waiting):
            s = owner[node]
            take = min(room[s], hi - lo)
            if take:
                out.append((cell, lo, lo + take, s, taken[s]))
                room[s] -= take
                taken[s] += take
            if lo + take < hi:
                passed.append((node, cell, lo + take, hi))
        waiting = [(with_room(node), cell, lo, hi) for node, cell, lo, hi in passed]
    return out


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """slack 0: as equal as whole numbers allow; else ceil((1 + slack) * mean) each."""
    if slack:
        return [-(-int(total * (1 + slack) * 1000) // (1000 * shards)) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def place(docs: DataFrame, shards: int = 24, slack: float = 0.0, id_col: str = "doc_id", text: str = "text", nodes: int = NODES) -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0) of every row; loads are rows.

    With slack 0 shard counts are at most one apart."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    bits = sized(shards, nodes)[1]
    keyed = scratch.table(keyed.withColumn("h", F.xxhash64("id", "crc", "size")).withColumn("cell", F.shiftrightunsigned("h", 64 - bits).cast("int")), "keys")
    loads = {r[0]: r[1] for r in keyed.groupBy("cell").count().collect()}  # a number for each cell at most, whatever the data
    parts = stretches(loads, capacities(sum(loads.values()), shards, slack), nodes)
    listed = json.dumps([dict(zip(("cell", "lo", "hi", "shard", "base"), p, strict=True)) for p in parts])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<cell:int,lo:long,hi:long,shard:int,base:long>>")))
    rank = (F.row_number().over(W.partitionBy("cell").orderBy("h", "id", "crc", "size")) - 1).cast("long")
    table = F.broadcast(table) if len(parts) <= BROADCAST_STRETCHES else table
    found = keyed.withColumn("rank", rank).join(table, "cell").filter("rank >= lo and rank < hi")
    return found.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.expr("base + rank - lo").alias("slot"))
