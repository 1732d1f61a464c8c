"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries are trained: one on words of ordinary labelled text, one on words
of toxic text.  A window's lengths after compression with the ordinary dictionary and with
ordinary plus toxic dictionary are compared: the difference (gain) says how much better the
toxic dictionary explains it.  A logistic calibration on held-back labelled rows turns the
gains of all windows of a text into a score.

What is compressed is the window spelled by prefixes: every letter becomes four bytes that
stand for its word up to and with it.  A match then always starts at the start of a
word, a letter that the dictionary does not foresee costs four bytes instead of a fraction of
one, and a common syllable inside another word saves nothing, so that the whole bytes in which
lengths are counted suffice to tell one short word from noise.

A toxic text holds mostly ordinary language, so the toxic dictionary is refined in ROUNDS:
windows of toxic texts are dealt into two halves by their content (copies fall into one
half); a dictionary trained on the words of one half picks from the other the words whose gain,
as a share of their length, is above that of a share QUANTILE of the words of ordinary windows
not used for training.  A window never explains itself this way, only what different windows share
is kept.  The ordinary dictionary's size is the frequency from which a beginning of words counts as
ordinary: too large, it holds beginnings that are rare in ordinary text and frequent in toxic text.
Both sizes follow the square root of the number of toxic texts that are learnt from (the toxic one has a
quarter): the more there are, the rarer the beginnings that can be relied on.

The model is fitted on the driver from at most `per_class` labelled rows and `most_bytes` bytes
of each class, chosen by a hash of the id (a text longer than a sixteenth of most_bytes is
not used for fitting); labels never reach the scoring.  Scoring takes whole texts.

Defined results: null and empty texts have no windows and get the score of all
zero gains; rows with equal texts score the same; without labels of
both classes every score is the share of toxic labels (0 without labels).  Repeated ids: the
least of their texts is fitted on, each row is scored by its own.  A column named as the
score is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textblocks import Block, Roller, blocks, mix64

PER_CLASS = 3000
MOST_BYTES = 12 << 20
WINDOW, TRAIN_WINDOW = 48, 64
ORDINARY_BYTES, TOXIC_BYTES = 1 << 17, 1 << 15  # at most
ROOT_BYTES = 2560  # bytes of the ordinary dictionary for the root of the number of toxic texts
CODE = 4  # bytes that stand for a letter
SEGMENT, MATCH = 32, 8  # bytes of the pieces that the trainer puts a dictionary together from, and of what it counts
QUANTILE, LEAST_SHARE, ROUNDS = 0.995, 0.1, 2
LEVEL = 12
STEPS = (3, 5, 7)
CHUNK = 1 << 19
RUN = re.compile(rb"[0-9a-z\x80-\xff]+")  # lower-case text
LETTER = np.array([RUN.match(bytes([i])) is not None for i in range(256)])
_PREFIXES = Roller(0x94D049BB133111EB)
Cuts = tuple[np.ndarray, np.ndarray, np.ndarray]


def windows(b: Block, size: int) -> Cuts:
    """(row, from, to) of every window of a block: the words that start in `size` bytes of a text; longer ones than
    four times that are cut evenly.  Each byte of a word is in exactly one window."""
    w = b.words()
    row = w.rows()
    if not w.n:
        return row, w.lo, w.hi
    k = (w.lo - b.lo[row]) // size
    new = np.ones(w.n, bool)
    new[1:] = (row[1:] != row[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    lo, hi, row = w.lo[first], w.hi[np.append(first[1:], w.n) - 1], row[first]
    parts = -(-(hi - lo) // (4 * size))
    step = -(-(hi - lo) // parts)
    i = np.repeat(np.arange(len(lo)), parts)
    at = lo[i] + (np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)) * step[i]
    return row[i], at, np.minimum(at + step[i], hi[i])


def packed(samples: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples as one buffer, and where each starts and ends."""
    size = np.array([len(x) for x in samples], np.int64)
    return np.frombuffer(b"".join(samples), np.uint8), np.cumsum(size) - size, np.cumsum(size)


def spelled(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters by the prefixes of their words, and where the code of each byte begins; a word ends at the
    next start."""
    inside = LETTER[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = starts[starts < len(buf)]
    first[starts] = inside[starts]
    i = np.flatnonzero(inside)
    lo = np.maximum.accumulate(np.where(first, np.arange(len(buf)), 0))[i]
    codes = _PREFIXES.ranges(_PREFIXES.prefix(buf.astype(np.uint64) + np.uint64(1)), lo, i + 1)
    return (mix64(codes) >> np.uint64(32)).astype("<u4").view(np.uint8), CODE * np.concatenate(([0], np.cumsum(inside)))


def spelled_words(words: list[bytes]) -> list[bytes]:
    buf, lo, hi = packed(words)
    out, at = spelled(buf, lo)
    return [out[a:b].tobytes() for a, b in zip(at[lo].tolist(), at[hi].tolist(), strict=True)]


def trained(words: dict[bytes, int], size: int) -> bytes:
    """The content of a dictionary trained on words, each as often as it counts, in an order by hash; with too few samples
    for the trainer, the words themselves."""
    names = sorted(w for w in words if len(w) > 1)
    code = dict(zip(names, spelled_words(names), strict=True))
    order = sorted((zlib.crc32(w + b"%d" % j), w) for w in names for j in range(words[w]))
    try:
        return zstandard.train_dictionary(size, [code[w] for _, w in order], k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:
        return b"".join(code.values())[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(content or bytes(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(raw), source_size=CODE * WINDOW, window_log=17, chain_log=17, hash_log=17, search_log=4, min_match=CODE, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    raw.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=how)


def compressed(with_: list[zstandard.ZstdCompressor], buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(compressors, windows): compressed length of every window, each spelled and compressed on its own; windows
    (in order) go in chunks, so memory does not follow a long text.  A window without letters has length 0."""
    out, s = np.zeros((len(with_), len(lo)), np.int64), 0
    while s < len(lo):
        e = max(s + 1, int(np.searchsorted(lo, lo[s] + CHUNK)))
        codes, at = spelled(buf[lo[s] : hi[e - 1]], lo[s:e] - lo[s])
        a, b = at[lo[s:e] - lo[s]], at[hi[s:e] - lo[s]]
        full = np.flatnonzero(b > a)
        if len(full):
            cuts = np.stack([a[full], (b - a)[full]], axis=1).astype(np.uint64).tobytes()
            for k, c in enumerate(with_):
                out[k, s + full] = np.fromiter(map(len, c.multi_compress_to_buffer(zstandard.BufferWithSegments(codes, cuts), threads=1)), np.int64, len(full))
        s = e
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]  # bias first
    centre: list[float]
    scale: list[float]
    share: float
    fitted: bool = True

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its compressors, made once in each task."""

    def __init__(self, model: Model):
        self.model = model
        if model.fitted:
            self.plain, self.toxic = compressor(model.ordinary), compressor(model.ordinary + model.toxic)

    def gains(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        plain, toxic = compressed([self.plain, self.toxic], buf, lo, hi)
        return plain - toxic

    def features(self, b: Block) -> np.ndarray:
        """For each text: its three largest gains, mean gain, windows (as logarithms) with at least STEPS, their share
        with more than 3, and the number of windows (as a logarithm)."""
        row, lo, hi = windows(b, WINDOW)
        gain, cut = self.gains(b.buf, lo, hi), np.searchsorted(row, np.arange(b.n + 1))
        out = np.zeros((b.n, 6 + len(STEPS)))
        for i in np.flatnonzero(np.diff(cut)):
            g = np.sort(gain[cut[i] : cut[i + 1]])[::-1].astype(float)
            out[i, : min(3, len(g))] = g[:3]
            out[i, 3:] = [g.mean(), *(math.log1p((g >= t).sum()) for t in STEPS), (g > 3).mean(), math.log(len(g))]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        m = self.model
        if not m.fitted:
            return np.full(len(texts), m.share)
        x = [self.features(b) for b in blocks(pc.utf8_lower(texts))]
        x = (np.concatenate(x) if x else np.zeros((0, 6 + len(STEPS)))) - np.asarray(m.centre)
        z = m.weights[0] + (x / np.asarray(m.scale)) @ np.asarray(m.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def window_samples(texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
    """The different windows of some texts in two halves by content."""
    found: set[bytes] = set()
    for b in blocks(pc.utf8_lower(pa.array(texts, pa.string()))):
        _, lo, hi = windows(b, TRAIN_WINDOW)
        found.update(b.buf[s:e].tobytes() for s, e in zip(lo.tolist(), hi.tolist(), strict=True))
    halves: tuple[list[bytes], list[bytes]] = ([], [])
    for x in sorted(found):
        halves[zlib.crc32(x) % 2].append(x)
    return halves


def word_counts(samples: list[bytes], least: int) -> dict[bytes, int]:
    """Words of at least so many bytes, with the number of samples that hold each."""
    return Counter(w for x in samples for w in set(RUN.findall(x)) if len(w) >= least)


def toxic_dictionary(ordinary: bytes, size: int, plain: list[bytes], halves: tuple[list[bytes], list[bytes]]) -> bytes:
    """The refined toxic dictionary; `plain` are ordinary windows that the ordinary dictionary was not trained on.

    Words of fewer than four bytes are left out: their codes are shorter than what a match costs."""
    known = word_counts(plain, 4)
    held = [word_counts(x, 4) for x in halves]
    chosen = list(held)
    for _ in range(ROUNDS):
        following = list(chosen)
        for k in (1, 0):  # what half k teaches picks from the other half
            scorer = Scorer(Model(ordinary, trained(chosen[k], size), [], [], [], 0.0))

            def share(words: dict[bytes, int], scorer: Scorer = scorer) -> np.ndarray:
                return scorer.gains(*packed(list(words))) / np.array([CODE * len(w) for w in words])

            limit = LEAST_SHARE
            if known:
                found, times = share(known), np.array(list(known.values()))
                order = np.argsort(found, kind="stable")
                run = np.cumsum(times[order])
                limit = max(limit, found[order][np.searchsorted(run, QUANTILE * run[-1])])
            following[1 - k] = {w: n for (w, n), g in zip(held[1 - k].items(), share(held[1 - k]), strict=True) if g > limit}
        if not any(following):
            break
        chosen = following
    return trained(dict(Counter(chosen[0]) + Counter(chosen[1])), size)


def fit(docs: list[tuple[str, int]], toxic_share: float) -> Model:
    """docs: (text, label 0/1), in a fixed order; every other one of a class calibrates."""
    by = {k: [t for t, y in docs if y == k] for k in (0, 1)}
    if min(map(len, by.values())) < 4:
        return Model(b"", b"", [0.0], [], [], toxic_share, fitted=False)
    learn, plain = window_samples(by[0][::2])
    size = min(ORDINARY_BYTES, int(ROOT_BYTES * math.sqrt(len(by[1][::2]))))
    ordinary = trained(Counter(w for x in learn for w in RUN.findall(x)), size)
    model = Model(ordinary, toxic_dictionary(ordinary, min(TOXIC_BYTES, size // 4), plain, window_samples(by[1][::2])), [], [], [], toxic_share)
    hold = by[0][1::2] + by[1][1::2]
    scorer, y = model.scorer(), np.repeat([0.0, 1.0], [len(by[0][1::2]), len(by[1][1::2])])
    x = np.concatenate([scorer.features(b) for b in blocks(pc.utf8_lower(pa.array(hold, pa.string())))])
    # the sample is balanced by class; weights restore the share of toxic labels
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, w = np.c_[np.ones(len(x)), (x - centre) / scale], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - 0.1 * w)
    model.weights, model.centre, model.scale = w.tolist(), centre.tolist(), scale.tolist()
    return model


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on labelled rows that are not held out.  An id with several labels counts as toxic if one says so."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    order = F.xxhash64(F.lit(11), F.col(id_col))
    pick = [r[0] for k in (0, 1) for r in known.filter(F.col("y") == k).orderBy(order, id_col).limit(per_class).select(id_col).collect()]
    if not pick:
        return fit([], share)
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in pick], f"{id_col} {docs.schema[id_col].dataType.simpleString()}"))  # 2 x per_class ids at most
    short = F.octet_length(F.coalesce(F.col(text), F.lit(""))) <= most_bytes // 16
    rows = docs.select(id_col, text).join(chosen, id_col).filter(short).groupBy(id_col).agg(F.min(text).alias("t")).join(known, id_col)
    before = F.sum(F.octet_length(F.coalesce("t", F.lit("")))).over(W.partitionBy("y").orderBy(order, id_col).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("bytes", before).filter(F.col("bytes") <= most_bytes).orderBy(order, id_col).select("t", "y").collect()
    return fit([(r[0], int(r[1])) for r in rows], share)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """Adds the score (0 to 1) of every whole text; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            found = pa.array(scorer.scores(batch.column(batch.schema.get_field_index(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    plain = docs.drop(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{schema}, `{column}` double")
