"""Tables whose columns may have any names: dots, backticks, or names that differ in case only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from inspect import signature

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

Batches = Iterator[pa.RecordBatch]


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns c0, c1 ... and the new name of every old one (of equal names the first)."""
    names = df.columns
    new: dict[str, str] = {}
    for i, name in enumerate(names):
        new.setdefault(name, f"c{i}")
    return df.toDF(*(f"c{i}" for i in range(len(names)))), new


def shielded(df: DataFrame, known: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """The table with every column but the known ones under a plain name, and the old names of those."""
    wanted, names, old = set(known), [], {}
    for i, name in enumerate(df.columns):
        if name in wanted and name not in names:
            names.append(name)
        else:
            names.append(f"e_{i}_")
            old[names[-1]] = name
    return df.toDF(*names), old


def unshielded(out: DataFrame, old: dict[str, str]) -> DataFrame:
    """The old names again; a column that the result has added under exactly that name stays instead."""
    added = {c for c in out.columns if c not in old}
    kept = [c for c in out.columns if old.get(c) not in added]
    return out.select(*[F.col(f"`{c}`") for c in kept]).toDF(*[old.get(c, c) for c in kept])


def any_names(*parameters: str, fixed: Iterable[str] = ()) -> Callable:
    """For operators on a table, their first argument: columns other than those that these parameters and `fixed` name
    may be called anything."""

    def wrap(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(work)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            given = signature(work).bind(df, *args, **options)
            given.apply_defaults()
            plain, old = shielded(df, [*fixed, *(given.arguments[p] for p in parameters)])
            return unshielded(work(plain, *args, **options), old)

        return run

    return wrap


def map_arrow(df: DataFrame, run: Callable[[Batches], Batches], fields: list[StructField]) -> DataFrame:
    """mapInArrow of a function that sees and gives columns by their own names."""
    old = df.columns
    safe = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])

    def renamed(batches: Batches) -> Batches:
        for out in run(batch.rename_columns(old) for batch in batches):
            yield out.rename_columns([f"c{i}" for i in range(out.num_columns)])

    return numbered(df)[0].mapInArrow(renamed, safe).toDF(*(f.name for f in fields))


def kept_fields(df: DataFrame, but: tuple[str, ...] = ()) -> list[StructField]:
    return [f for f in df.schema.fields if f.name not in but]


def field(name: str, kind: str) -> StructField:
    return StructField(name, DataType.fromDDL(kind))
