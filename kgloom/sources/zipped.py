"""Delimited tables inside ZIP archives as a data source: a partition for each member, only the columns that are asked for."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Executors need not have this package installed: the source travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "zipped_table"


class Member(InputPartition):
    """One member of one archive."""

    def __init__(self, path: str, name: str):
        super().__init__((path, name))
        self.path, self.name = path, name


def _opened(path: str):
    """An archive that is read by ranges, from any store that pyarrow knows."""
    import zipfile

    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(store.open_input_file(inside))


class ZippedTables(DataSource):
    """Options: path (archives, joined by commas), members (a pattern of names), sep.

    The schema names the columns to read, letter case ignored; `_member` gives the member's name.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("give the columns to read as a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZippedReader(schema, dict(self.options))


class ZippedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.kinds = schema.names, [f.dataType.simpleString() for f in schema.fields]
        self.paths, self.pattern, self.sep = options["path"].split(","), options.get("members", r"\.(tsv|csv|txt)$"), options.get("sep", "\t")
        self.schema = schema

    def partitions(self) -> list[Member]:
        """Only the archives' directories are read here."""
        import re

        found = [(path, n) for path in self.paths for n in _opened(path).namelist()]
        return [Member(path, n) for path, n in found if re.search(self.pattern, n) and not n.endswith("/")]

    def read(self, partition: Member):
        """The member as a stream of batches; a column that it lacks is an error that names the member."""
        import pyarrow as pa
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no member fits
            return
        wanted = to_arrow_schema(self.schema)
        with _opened(partition.path) as archive, archive.open(partition.name) as head:
            header = head.readline().decode("utf-8-sig").rstrip("\r\n").split(self.sep)
        by_low = {c.strip('"').lower(): c.strip('"') for c in reversed(header)}
        real = {n: by_low.get(n.lower()) for n in self.names if n != "_member"}
        if lacking := [n for n, c in real.items() if c is None]:
            raise ValueError(f"{partition.name} in {partition.path} has no column {', '.join(lacking)}; it has {', '.join(header)}")
        convert = csv.ConvertOptions(include_columns=list(real.values()), column_types={real[n]: wanted.field(n).type for n in real}, strings_can_be_null=True, null_values=[""])
        with _opened(partition.path) as archive, archive.open(partition.name) as body:
            for batch in csv.open_csv(body, parse_options=csv.ParseOptions(delimiter=self.sep), convert_options=convert):
                of = lambda n: pa.array([partition.name] * len(batch), pa.string()) if n == "_member" else batch.column(real[n])
                yield pa.RecordBatch.from_arrays([of(n) for n in self.names], schema=wanted)


def read_zipped(spark: SparkSession, paths: list[str], schema: str, members: str = r"\.(tsv|csv|txt)$", sep: str = "\t") -> DataFrame:
    """Some columns of every matching member of the archives (S18); nothing is extracted to disk."""
    spark.dataSource.register(ZippedTables)
    return spark.read.format(FORMAT).schema(schema).option("path", ",".join(paths)).option("members", members).option("sep", sep).load()


def atlas_mapping(spark: SparkSession, path: str, members: str = "proteinatlas") -> DataFrame:
    """(Ensembl, Uniprot) of an expression atlas's archive: both ids trimmed, rows without one left out."""
    df = read_zipped(spark, [path], "Ensembl string, Uniprot string", members)
    return df.select(F.trim("Ensembl").alias("Ensembl"), F.trim("Uniprot").alias("Uniprot")).where("Ensembl <> '' and Uniprot <> ''")


# The kinds of activity that are kept.
ACTIVITY_TYPES = ("IC50", "Ki", "Kd", "Inhibition")


def activity_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(enzyme_uniprot_id, target_chembl_id, compound_chembl_id, compound_name, type, value, units) of saved result pages.

    Pages are JSON files of folder/<enzyme>/<target>/, each with its `activities`; a file is read by
    one task, and only the fields named here are parsed. Other kinds of activity are left out.
    """
    record = "molecule_chembl_id string, molecule_pref_name string, standard_type string, standard_value string, standard_units string"
    pages = spark.read.schema(f"activities array<struct<{record.replace(' string', ': string')}>>").option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    parts = F.split(F.input_file_name(), "/")
    of = F.element_at
    each = pages.select(of(parts, -3).alias("enzyme_uniprot_id"), of(parts, -2).alias("target_chembl_id"), F.explode("activities").alias("a")).where(F.col("a.standard_type").isin(*ACTIVITY_TYPES))
    return each.select("enzyme_uniprot_id", "target_chembl_id", F.col("a.molecule_chembl_id").alias("compound_chembl_id"), F.col("a.molecule_pref_name").alias("compound_name"), F.col("a.standard_type").alias("type"), F.col("a.standard_value").try_cast("double").alias("value"), F.col("a.standard_units").alias("units"))
