"""Quality rules with risk-controlled cutoffs (operator 10).

Base counts are taken over whole texts.  A rule rejects a text when a ratio of
these counts exceeds a cutoff.  Cutoffs are chosen on the labelled rows: for a
stratum (language) and rule the fixed grid is walked from the laxest cutoff to
the strictest; a cutoff is taken while the exact binomial test rejects "more than
alpha / rules of the good texts would be lost" at level delta / (rules x strata).
Walking in a fixed order needs no further correction, Bonferroni covers rules and
strata, and the shares alpha / rules add up: with probability 1 - delta no stratum
loses more than alpha of those of its good texts that pass the base rule to these rules.

Defined results: null text has no words; a null language is a stratum of its own;
every stratum is tested on its own, and one without enough labels
for a test keeps everything that the base rule keeps; a doc_id with several labels
counts once, as good if one label says so; labels of unknown ids are ignored; columns named as the
added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textblocks import blocks, gram_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: rule -> (ratio of base counts, grid from lax to strict)
RULES = {
    "symbols": ("n_symbols / nullif(n_words, 0)", (5.0, 4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
    "dup_lines": ("10 * n_dup_lines / nullif(n_words, 0)", (5.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / nullif(n_words, 0)", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    "short_words": ("n_words / nullif(word_chars, 0)", (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
}


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and takes the text away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            parts = []
            for b in blocks(batch.column(at)):
                w = b.words()
                n = w.row_hi - w.row_lo
                letters = np.concatenate(([0], np.cumsum((b.buf & 0xC0) != 0x80)))
                per_word = np.concatenate(([0], np.cumsum(letters[w.hi] - letters[w.lo])))
                signs = np.concatenate(([0], np.cumsum(_SYMBOL[b.buf])))
                parts.append(np.stack([n, per_word[w.row_hi] - per_word[w.row_lo], signs[b.hi] - signs[b.lo], _repeated_lines(b), _repeated_words(w)]))
            out = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x.astype(np.int64)) for x in out)], names=[*names, *COUNTS])

    plain = docs.drop(*COUNTS, "base_failed")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != text)
    counted = plain.mapInArrow(run, f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_lines(b) -> np.ndarray:
    out = np.zeros(b.n, np.int64)
    for i in range(b.n):
        lines = [x for x in b.text(i).split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def _repeated_words(w) -> np.ndarray:
    """Words in 3-word windows that the same text holds twice or more."""
    if w.n < 3:
        return np.zeros(w.block.n, np.int64)
    row = w.rows()
    at = np.flatnonzero(row[2:] == row[:-2])
    grams, r = gram_hashes(w.hashes(), 3)[at], row[at]
    order = np.lexsort((grams, r))
    g, q = grams[order], r[order]
    same = (g[1:] == g[:-1]) & (q[1:] == q[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(w.n + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return inside[w.row_hi] - inside[w.row_lo]


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    top = n * p
    logs, out = [], 0.0
    for i in range(max(0, int(top - 40 * math.sqrt(top + 1) - 40)), k + 1):
        logs.append(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    for x in sorted(logs):
        out += math.exp(x)
    return min(1.0, out)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate after k of n."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_at_most(k, n, mid) > delta else (lo, mid)
    return hi


def choose_cutoffs(counts: DataFrame, labels: DataFrame, alpha: float, delta: float, stratum: str, id_col: str, label: str) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> strictest cutoff that the tests allow; counts holds base counts of all rows."""
    good = labels.groupBy(id_col).agg(F.max(label).alias("y")).filter("y = 1").select(id_col)
    usable = counts.filter("not base_failed").join(good, id_col, "left_semi")
    sums = [F.sum((F.expr(ratio) > c).cast("long")).alias(f"{rule}_{i}") for rule, (ratio, grid) in RULES.items() for i, c in enumerate(grid)]
    rows = usable.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *sums).collect()  # one row for each stratum
    out = {}
    level, share = delta / (len(RULES) * max(1, len(rows))), alpha / len(RULES)
    for r in rows:
        for rule, (_, grid) in RULES.items():
            for i, cutoff in enumerate(grid):
                if upper_bound(r[f"{rule}_{i}"], r["n"], level) > share:
                    break
                out[r[stratum], rule] = cutoff
    return out


def risk_controlled(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum: str = "lang", id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Base counts, base_failed and kept for every row; the text is not carried along."""
    name = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))
    counts = scratch.table(base_counts(docs.withColumn("stratum#", name), text), "counts")
    cutoffs = choose_cutoffs(counts, labels, alpha, delta, "stratum#", id_col, label)
    rows = [(s, *(cutoffs.get((s, rule)) for rule in RULES)) for s in sorted({s for s, _ in cutoffs})]  # strata with labels
    table = docs.sparkSession.createDataFrame(rows, "`stratum#` string, " + ", ".join(f"`{rule}#` double" for rule in RULES))
    rejected = F.lit(False)
    for rule, (ratio, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(ratio) > F.col(f"{rule}#"), F.lit(False))
    out = counts.join(table, "stratum#", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.drop("stratum#", *[f"{rule}#" for rule in RULES])
