"""Readers of tables, records and lines. Everything is read by Spark, so any store works."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import first_column

FORMATS = {".csv": ("csv", ","), ".tsv": ("csv", "\t"), ".txt": ("csv", "\t"), ".json": ("json", None), ".jsonl": ("json", None), ".parquet": ("parquet", None)}


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs, [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, bad_lines: str = "DROPMALFORMED") -> DataFrame:
    """A table by its suffix: csv, tsv, json, jsonl or parquet (S2, S3, S6). Malformed lines are left out.

    Without a schema all text columns are strings, so nothing is read twice to infer types.
    """
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown suffix {suffix!r}; known: {', '.join(FORMATS)}")
    kind, sep = FORMATS[suffix]
    reader = spark.read.option("mode", bad_lines)
    reader = reader.schema(schema) if schema else reader
    if kind == "csv":
        return reader.option("header", True).option("sep", sep).option("multiLine", False).csv(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    return reader.json(path) if kind == "json" else spark.read.parquet(path)


def read_folder(spark: SparkSession, folder: str, suffix: str = ".tsv", schemas: dict | None = None) -> dict[str, DataFrame]:
    """Every table of a folder by its stem."""
    _, paths = _files(spark, folder)
    named = {p.getName()[: -len(suffix)]: p.toString() for p in paths if p.getName().endswith(suffix)}
    return {stem: read_table(spark, path, (schemas or {}).get(stem)) for stem, path in sorted(named.items())}


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, Parquet where there is any, else TSV; an error where there is neither."""

    def one(name: str) -> DataFrame:
        for suffix in (".parquet", ".tsv"):
            if exists(spark, f"{folder}/{name}{suffix}"):
                return read_table(spark, f"{folder}/{name}{suffix}")
        raise FileNotFoundError(f"neither {name}.parquet nor {name}.tsv in {folder}")

    return one("nodes"), one("edges")


def read_records(spark: SparkSession, path: str, key: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects, or a file of them, the last of equal keys."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_ord", F.monotonically_increasing_id())
    rest = [c for c in df.columns if c not in (key, "_ord")]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), "_ord").alias("_r"))
    return last.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def parse_lines(lines: DataFrame, fields: list[tuple[str, str]], least: int, column: str = "value") -> DataFrame:
    """Fields of tab-separated lines; comments and lines with fewer than `least` fields give nulls in `bad`.

    fields: (name, type) in order. Values that don't fit their type become null; the row stays.
    """
    real = lines.where(~F.col(column).startswith("#") & (F.trim(column) != ""))
    parts = F.split(F.col(column), "\t")
    cast = lambda k, kind: F.get(parts, F.lit(k)) if kind == "string" else F.get(parts, F.lit(k)).try_cast(kind)
    return real.select(*(cast(k, kind).alias(name) for k, (name, kind) in enumerate(fields)), (F.size(parts) < least).alias("bad"))


def with_label(df: DataFrame, candidates: list[str], name: str = "label") -> DataFrame:
    """df with the first label column that it has under one name; an error without any."""
    found = first_column(df, candidates)
    if found is None:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return df.withColumn(name, F.col(found))


def select_ignoring_case(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, whatever the letter case of the header."""
    found = {n: first_column(df, [n]) for n in names}
    lack = [n for n, c in found.items() if c is None]
    if lack:
        raise ValueError(f"no column {lack} in {df.columns}")
    return df.select(*(F.col(c).alias(n) for n, c in found.items()))


def first_list(*columns: Column) -> Column:
    """The first array that is there, even if it is empty."""
    return F.coalesce(*columns)


def pending_ids(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids that are wanted and not done yet."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(done.select(key), key, "left_anti")


def screen(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others with the first reason that holds."""
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def annotation_strings(df: DataFrame, records: str, key: str, value: str) -> Column:
    """`key|value;…` of an array of structs, nulls left out."""
    entry = lambda r: F.concat_ws("|", r[key], r[value])
    return F.array_join(F.transform(F.filter(F.col(records), lambda r: r[key].isNotNull()), entry), ";")


def parse_metadata(text: Column) -> Column:
    """A JSON object's fields as a map of strings; blank and invalid text give an empty map."""
    parsed = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def find_deep(text: Column, names: list[str], most: int = 10) -> Column:
    """The first string under one of the names anywhere in a JSON text, depth-first to a depth."""
    import json

    def search(v, depth):
        if depth > most:
            return None
        if isinstance(v, dict):
            for n in names:
                if isinstance(v.get(n), str) and v[n]:
                    return v[n]
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            if (found := search(x, depth + 1)) is not None:
                return found
        return None

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return search(json.loads(t), 0) if t else None
            except ValueError:
                return None

        return texts.map(one)

    return run(text)


def experiments(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row an experiment folder: its metrics.json, else its results.json."""
    fs, paths = _files(spark, folder)
    found = []
    for p in paths:
        for name in ("metrics.json", "results.json"):
            if exists(spark, f"{p.toString()}/{name}"):
                found.append(f"{p.toString()}/{name}")
                break
    if not found:
        return spark.createDataFrame([], f"experiment string, {schema}")
    df = spark.read.schema(schema).option("multiLine", True).json(found)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("experiment"), "*")
