"""Spelling variant grouping without pairs (operator 13).

Words are counted with map-side combination and ranked by one distributed sort: most frequent first, ties in
code-point order, so "the better word" is the smaller rank and only ranks travel.  Two words that differ by one
replaced code point share exactly one (position, prefix, suffix) group; a group keeps its size and its two best words,
and every member reads off how many near words it has there and which is the best: the first, or the second for the
first itself.  A group holds one word for each letter at most.  Two words that differ by one inserted code point meet
when the deletions of the longer one are joined with the vocabulary; both sides are summed up at once.  No pair of a
group is ever formed.

Prefixes and suffixes are carried as the value of a polynomial of the word's code points modulo 2**127 - 1, with a
blank in place of the letter, so a word of any length gives as many short keys as it has letters.

Defined results: a null text has no words; a null id counts as empty text before the colon; words below `least_length`
or `least_count` are left out and near to nothing; of near words with equal counts the smaller one is the form; a word
without near words is its own root; repeated rows count as often as they occur; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

_RUN = re.compile("[a-zÀ-ÿ]+")
_PRIME, _BASE = (1 << 127) - 1, 0x1F3D5B79A2C4E6870123456789ABCDEF
HELD = 200_000  # different words that a task counts before it sends them on


def words_of(doc_id: object, text: str, least_length: int, damage: int = 199) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text: runs of letters, A-Z lower-cased; where `damage` divides the checksum of id and
    run, the run loses one code point."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, k in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes.lower() knows A-Z only
        if len(run) < least_length:
            continue
        h = zlib.crc32(run.encode(), before)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least_length:
                continue
        yield run, k


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all words long and frequent enough."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, t in zip(batch["id"], batch["text"], strict=True):
                for word, k in words_of(doc_id, t, least_length):
                    held[word] += k
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _value(codes: list[int]) -> int:
    h = 1
    for c in codes:
        h = (h * _BASE + c) % _PRIME
    return h


def word_keys(word: str) -> tuple[bytes, list[bytes], list[bytes]]:
    """Key of the word, of the word with each letter blanked, and of its different deletions."""
    codes = [ord(c) for c in word]
    n, powers, before = len(codes), [1], [1]
    for c in codes:
        powers.append(powers[-1] * _BASE % _PRIME)
        before.append((before[-1] * _BASE + c) % _PRIME)
    blanked, deleted, after = [], [], 0  # after: value of the letters behind i
    for i in range(n - 1, -1, -1):
        blanked.append((before[n] - codes[i] * powers[n - 1 - i]) % _PRIME)
        if i == 0 or codes[i] != codes[i - 1]:  # of a run of one letter every deletion is the same word
            deleted.append((before[i] * powers[n - 1 - i] + after) % _PRIME)
        after = (after + codes[i] * powers[n - 1 - i]) % _PRIME
    pack = lambda h: h.to_bytes(16, "big")
    return pack(before[n]), [pack(h) for h in blanked], [pack(h) for h in deleted]


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, role, rank): W the word itself, R with a letter blanked, D with one left out; a word at a time, so that
    long words make no large batch."""
    for batch in batches:
        key, role, rank = [], [], []
        for r, word in zip(batch["rank"], batch["word"], strict=True):
            own, blanked, deleted = word_keys(word)
            key += [own, *blanked, *deleted]
            role += ["W", *("R" * len(blanked)), *("D" * len(deleted))]
            rank += [r] * (1 + len(blanked) + len(deleted))
            if len(key) > 50_000:
                yield pd.DataFrame({"key": key, "role": role, "rank": rank})
                key, role, rank = [], [], []
        if key:
            yield pd.DataFrame({"key": key, "role": role, "rank": rank})


def near_words(ranked: DataFrame, scope: scratch.Scope) -> DataFrame:
    """rank, n_near, best: number of near words and the least rank among them, for words that have any."""
    keys = scope.table(ranked.select("rank", "word").mapInPandas(_keys, "key binary, role string, rank long"), "keys")
    # one letter of the alphabet each: 90 members at most
    groups = keys.filter("role = 'R'").groupBy("key").agg(F.array_sort(F.collect_list("rank")).alias("members")).filter(F.size("members") > 1)
    replaced = groups.select(F.explode("members").alias("rank"), F.size("members").alias("size"), F.col("members")[0].alias("first"), F.col("members")[1].alias("second")).select(
        "rank", (F.col("size") - 1).cast("long").alias("near"), F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best")
    )
    shorter = keys.filter("role = 'W'").select("key", F.col("rank").alias("short"))
    met = keys.filter("role = 'D'").select("key", F.col("rank").alias("long")).join(shorter, "key")
    # either side of a meeting is one near word of the other
    indels = met.select(F.inline(F.array(F.struct(F.col("long").alias("rank"), F.lit(1).cast("long").alias("near"), F.col("short").alias("best")), F.struct(F.col("short").alias("rank"), F.lit(1).cast("long").alias("near"), F.col("long").alias("best")))))
    return replaced.unionByName(indels).groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(docs: DataFrame, factor: int = 5, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    if factor < 2:
        raise ValueError("a form must be more frequent than its variant")
    scope = scratch.Scope(docs.sparkSession)
    counted = vocabulary(docs, least_length, least_count, id_col, text).orderBy(F.col("n").desc(), "word")
    ranked = scope.table(counted.withColumn("rank", F.monotonically_increasing_id()), "words")
    near = near_words(ranked, scope)
    best = ranked.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    found = scope.table(ranked.select("rank", "n").join(near, "rank").join(best, "best").select("rank", "n_near", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")).alias("form")), "near")

    # a form is at least `factor` times as frequent, so chains are short; every round doubles the way known
    top = ranked.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(max(1, top / least_count), factor)) + 1)
    way = found.filter("form is not null").select("rank", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(steps))):
        if i:
            way = scope.table(way, "way")
        onward = way.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        way = way.join(onward, "root", "left").select("rank", F.coalesce("further", "root").alias("root"))
    name = lambda c, *more: ranked.select(F.col("rank").alias(c), *more)
    out = ranked.join(found, "rank", "left").join(way, "rank", "left")
    out = out.join(name("form", F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form", "left").join(name("root", F.col("word").alias("root_word")), "root", "left")
    out = out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    kept = scratch.table(out, "variants")
    scope.close()
    return kept
