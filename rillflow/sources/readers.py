"""Sources: CSV with explicit keys, Latin-1 attribute tables, zipped CSV members, gzipped RDB text, manifests, sinks."""

from __future__ import annotations

import csv
import datetime as dt
import gzip
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import canonical_key, resolve_columns


def read_csv(spark: SparkSession, path: str, schema: str | None = None, keys: Sequence[str] = (), encoding: str = "UTF-8") -> DataFrame:
    """CSV with header; without a schema every column is text.  Key columns are put into their one spelling."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumns({k: canonical_key(F.col(k)) for k in keys}) if keys else df


def read_attributes(spark: SparkSession, path: str, key: str = "STAID", columns: Sequence[str] | None = None) -> DataFrame:
    """Latin-1 attribute table: the key as text, everything else as number where it is one, columns that exist."""
    df = read_csv(spark, path, keys=[key], encoding="ISO-8859-1")
    names = [c for c in resolve_columns(df, columns or df.columns) if c != key]
    return df.select(key, *names)


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def read_zipped_csv(spark: SparkSession, path: str, member: str, schema: str, encoding: str = "latin-1") -> DataFrame:
    """One member of each zip archive under path; columns by name, missing ones null, all as text."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member not in z.namelist():
                        continue
                    rows = csv.DictReader(io.TextIOWrapper(z.open(member), encoding))
                    held = [{n: r.get(n) for n in names} for r in rows]
                yield pd.DataFrame(held, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{n} string" for n in names))


CHUNK = 50_000  # rows of a frame that a task sends
Row = tuple[str, dt.date, float | None, int]


def _day(text: str) -> dt.date | None:
    try:
        return dt.date.fromisoformat(text.strip()[:10])
    except ValueError:
        return None


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _flow_column(header: list[str], mode: str) -> int:
    flows = [i for i, c in enumerate(header) if "00060" in c and "_cd" not in c]
    mean = [i for i in flows if header[i].endswith("_00060_00003") or (mode == "C" and "00003" in header[i])]
    return ({"A": flows, "B": mean, "C": mean or flows}[mode] or [-1])[0]


def _sections(lines: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """(header fields, lines after the format line) of every section."""
    at = [i for i, x in enumerate(lines) if x.startswith("agency_cd")]
    for i, j in zip(at, [*at[1:], len(lines)], strict=True):
        yield lines[i].strip().split("\t"), lines[i + 2 : j]


def parse_rdb(text: str, mode: str = "B") -> Iterator[Row]:
    """(site, day, flow, section) of tab-separated daily values, in the order of the file.

    Lines with # are comments; a line that starts with agency_cd opens a section and is followed by a format line.
    Mode A: stripped rows of three fields or more; the site of a section's first row, the first flow column of any
    statistic, days 1980 to 2025; a section with a row longer than its columns is dropped, and so is one without days.
    Mode B: site and day of each row by place, the daily mean column of each section.
    Mode C: the columns of the first section for all, daily mean first and else any; rows without flow or with negative
    flow are dropped."""
    lines = [x for x in text.splitlines() if not x.startswith("#")]
    first: list[str] | None = None
    for section, (header, rows) in enumerate(_sections(lines)):
        first = first or header
        if mode == "A":
            fields = [y for x in rows if len(y := x.strip().split("\t")) >= 3]
            names = header[: len(fields[0])] if fields else []
            column = _flow_column(names, mode)
            if column < 0 or "site_no" not in names or "datetime" not in names or max(map(len, fields)) > len(names):
                continue
            site, at = fields[0][names.index("site_no")], names.index("datetime")
            for y in fields:
                if at < len(y) and (day := _day(y[at])) and dt.date(1980, 1, 1) <= day <= dt.date(2025, 12, 31):
                    yield site, day, _number(y[column]) if column < len(y) else None, section
            continue
        names = first if mode == "C" else header
        column = _flow_column(names, mode)
        if column < 0 or (mode == "C" and not {"site_no", "datetime"} <= set(names)):
            continue
        place, at = (names.index("site_no"), names.index("datetime")) if mode == "C" else (1, 2)
        for x in rows:
            y = x.split("\t")
            if len(y) <= max(place, at, column) or not (day := _day(y[at])):
                continue
            flow = _number(y[column])
            if mode == "B" or (flow is not None and flow >= 0):
                yield y[place].strip(), day, flow, section


def read_rdb(spark: SparkSession, path: str | list[str], mode: str = "B") -> DataFrame:
    """Daily flow of gzipped (or plain) RDB files, in the order of their paths: site, day, flow.

    Mode A: the last section that a site has, in the last file, replaces the others; its rows are kept as they are, so a
    day may come twice.  Mode B: the last file that a site has replaces the others, its first row of a day counts.
    Mode C: all files together, the first row of a day counts.

    Files are read twice: first for the sites they hold, from which follows what counts of each file (some sites a file),
    then for these rows; so rows of A and B are not shuffled or joined, and none carries its file's name."""

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def sites(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                last: dict[str, int] = {}
                for site, _, _, section in parse_rdb(_text(content), mode):
                    last[site] = section
                yield pd.DataFrame([(name, *x) for x in last.items()], columns=["path", "raw", "section"])

    held = files.mapInPandas(sites, "path string, raw string, section int").withColumn("site", canonical_key(F.col("raw")))
    whose = F.struct("raw", "site", "section")
    if mode != "C":  # a site's rows are all in one file
        last = held.groupBy("site").agg(F.max(F.struct("path", "section")).alias("l")).select("site", "l.*")
        held = held.join(last.hint("shuffle_hash"), ["site", "path", "section"] if mode == "A" else ["site", "path"], "left_semi").select("path", "raw", "site", "section")
    kept = held.groupBy("path").agg(F.collect_list(whose).alias("kept"))
    if mode == "C":
        kept = kept.withColumn("place", F.row_number().over(W.orderBy("path")).cast("long"))  # a row for each file
    else:
        kept = kept.withColumn("place", F.lit(0).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, wanted, place in zip(pdf["content"], pdf["kept"], pdf["place"], strict=True):
                names, seen, rows = {x["raw"]: (x["site"], x["section"]) for x in wanted}, set(), []
                for raw, day, flow, section in parse_rdb(_text(content), mode):
                    site, final = names.get(raw, (None, -1))
                    if site is None or (mode == "A" and section != final):
                        continue
                    if mode != "A":
                        if (site, day) in seen:
                            continue
                        seen.add((site, day))
                    rows.append((site, day, flow, place))
                    if len(rows) == CHUNK:
                        yield pd.DataFrame(rows, columns=["site", "day", "flow", "place"])
                        rows = []
                yield pd.DataFrame(rows, columns=["site", "day", "flow", "place"])

    rows = files.join(F.broadcast(kept), "path").select("content", "kept", "place").mapInPandas(run, "site string, day date, flow double, place long")
    if mode == "C":
        return rows.groupBy("site", "day").agg(F.min_by("flow", "place").alias("flow"))
    return rows.select("site", "day", "flow")


def _text(content: bytes) -> str:
    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("latin-1")


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows; by `order` if given."""
    return (df.orderBy(*order) if order else df).limit(n)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, missing: str | None = "") -> DataFrame:
    """Adds the value of a key from a small table of one row a key; missing ones get `missing`, or go if it is None."""
    small = table.select(key, value)
    if missing is None:
        return df.join(small, key)
    return df.join(small, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(missing)))


def outer_chain(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of attribute tables; a column that an earlier one has is not taken again."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.select(key, *[c for c in t.columns if c not in out.columns]), key, "full")
    return out


def column_catalog(df: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """place, name, n, distinct, least and greatest value of every number column that is not left out, from one pass."""
    names = numeric_columns(df, but)
    stats = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.count(c).alias("n"), F.count_distinct(c).alias("values"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")) for i, c in enumerate(names)]
    return df.agg(F.array(*stats).alias("all")).select(F.inline("all"))


def numeric_columns(df: DataFrame, but: Sequence[str] = ()) -> list[str]:
    """Names of number columns, without those to leave out, decided at plan time."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """n rows that a hash of their key chooses: the same ones wherever the rows lie."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit("42"), *[F.col(k).cast("string") for k in key]))).limit(n)


def manifest_files(manifest: DataFrame, wanted: DataFrame, file: str = "raw_file", sites: str = "sites", key: str = "gauge") -> DataFrame:
    """Files whose comma-separated site list meets the wanted keys."""
    listed = manifest.select(file, F.explode(F.split(sites, ",")).alias("s")).select(file, canonical_key(F.col("s")).alias(key))
    return listed.join(wanted.select(canonical_key(F.col(key)).alias(key)), key, "left_semi").select(file).distinct()


def read_manifest(spark: SparkSession, manifest: DataFrame, wanted: DataFrame, folder: str, mode: str = "B", file: str = "raw_file", key: str = "gauge") -> tuple[DataFrame, DataFrame]:
    """Daily flow of the wanted sites from those files of a folder that the manifest names for them, and a table of these
    files (file, found).

    The list of files is made first; only files that exist are opened, and only wanted sites of them are kept.  A file
    that is listed but missing is reported, not an error."""
    names = sorted(r[0] for r in manifest_files(manifest, wanted, file, key=key).collect() if r[0] is not None)  # names of files
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [name for name in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(root, name))]
    there = set(found)
    report = spark.createDataFrame([(name, name in there) for name in names], "file string, found boolean")
    if not found:
        return spark.createDataFrame([], "site string, day date, flow double"), report
    keys = wanted.select(canonical_key(F.col(key)).alias("site")).distinct()
    return read_rdb(spark, [f"{folder}/{name}" for name in found], mode).join(keys, "site", "left_semi"), report


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrites path; CSV gets a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def fill_missing(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """old with the columns' nulls filled from new; write the result elsewhere than old was read from."""
    fresh = new.select(*keys, *[F.col(c).alias(f"{c}#") for c in columns])
    out = old.join(fresh, list(keys), "left")
    return out.select(*[F.coalesce(c, f"{c}#").alias(c) if c in columns else F.col(c) for c in old.columns])
