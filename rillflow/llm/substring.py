"""Substring dedup: seed and extend on winnowed word anchors (operator 3).

Seeds are winnowed 8-word anchors.  Documents meet where they share an anchor;
the match is extended both ways to the whole windows around it, and the union of
matching windows is the set of maximal repeats of at least `length` words.

Defined results: null text has no words; a text that occurs twice or more loses
all its words if it has `length` of them; shorter texts lose none; other
columns, null or not, are passed through by `remove_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .anyname import any_names
from .repeats import WINDOW, candidates, carried, contexts, covered, expand, removals, restored, shared_windows, windows_of, with_content

SEED_WORDS = 8
SPACES = b" \t\n\x0b\x0c\r"


@any_names("text")
def remove_repeats(docs: DataFrame, length: int = 35, text: str = "text", joiner: str = "space", seed: int = SEED_WORDS) -> DataFrame:
    """Adds n_words, n_removed and kept (the remaining text) to every row.

    joiner "space": kept words joined by one space.  joiner "source": the text
    as it was, without the removed words and the white space after them.

    Null and empty texts have no words; repeated rows and ties are rows like any other and lose what they share; an empty
    table gives no rows; columns named exactly as the added ones are replaced, others stay, whatever their names."""
    seed = min(seed, length)
    base, scope = with_content(carried(docs, text)), scratch.Scope(docs.sparkSession)
    cand = candidates(base, "word", length, seed, scope)
    ctxs = contexts(cand)
    shared = shared_windows(expand(base, ctxs, windows_of("word", length), WINDOW))
    found = scratch.table(removals(base, cand, ctxs, shared), "removals")
    scope.close()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            lows, highs = batch.column(2), batch.column(3)
            for i, value in enumerate(batch.column(1)):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                words = raw.split()
                lo = lows[i].values if lows[i].is_valid else None
                mask = covered(len(words), length, None if lo is None else lo.to_numpy(), None if lo is None else highs[i].values.to_numpy())
                gone = int(mask.sum())
                total.append(len(words))
                removed.append(gone)
                if not gone:
                    kept.append(b" ".join(words) if joiner == "space" else raw)
                elif joiner == "space":
                    kept.append(b" ".join(compress(words, (~mask).tolist())))
                else:
                    kept.append(without(raw, words, mask))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["row", "text", "n_words", "n_removed", "kept"],
            )

    row = base.schema["row"].dataType.simpleString()
    wide = base.join(found, ["c1", "c2"], "left").select("row", "text", "run_lo", "run_hi")
    out = wide.mapInArrow(cut, f"row {row}, text string, n_words long, n_removed long, kept string")
    return restored(out, docs, text, ["n_words", "n_removed", "kept"])


def without(raw: bytes, words: list[bytes], mask: np.ndarray) -> bytes:
    """The text without the words in mask, each with the white space that follows it."""
    out, at = [], 0
    for word, gone in zip(words, mask.tolist(), strict=True):
        start = raw.index(word, at) if raw[at : at + len(word)] != word else at
        stop = start + len(word)
        while stop < len(raw) and raw[stop] in SPACES:
            stop += 1
        if not gone:
            out.append(raw[at:stop])
        at = stop
    return b"".join(out).rstrip(SPACES)
