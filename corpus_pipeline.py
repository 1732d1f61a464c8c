"""Corpus pipeline: five stages applied one after another to `documents`.

Each stage reads what its predecessor kept; all but the last return the columns of
`documents`.  Intermediate tables lie in the shared folder (spark.checkpoint.dir).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import scratch, toxicity
from rillflow.llm.anyname import shielded, unshielded
from rillflow.llm.bagminhash import one_of_each
from rillflow.llm.decontaminate import clean
from rillflow.llm.packing import pack
from rillflow.llm.queries import word_tokenizer
from rillflow.llm.substring import remove_repeats
from rillflow.session import prepare

TOXIC_FROM = 0.3
SIMILARITY = 0.8
REPEAT_WORDS = 35
WINDOW = 2048
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage in a session that knows this package; further columns of its table may have any names."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain, old = shielded(docs, COLUMNS)
        return unshielded(work(prepare(spark), plain, sf_dir), old)

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents scored TOXIC_FROM or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, column="score#").filter(F.col("score#") < TOXIC_FROM).select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each class stays."""
    return one_of_each(docs, threshold=SIMILARITY)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: words of repeated passages go, other text stays as it was; a document left without words goes."""
    out = remove_repeats(docs, length=REPEAT_WORDS, joiner="source").filter("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return out.withColumns(new).select(*docs.columns)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item, edited or not, go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: pieces of windows that hold the sources in the corpus's own proportions."""
    return pack(docs, word_tokenizer(), window=WINDOW)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_tokens),
]
ORACLE_SQL = None  # compression lengths and signatures are beyond SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = scratch.table(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
