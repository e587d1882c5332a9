"""Writers of graphs, reports and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet, edges by relation, and as TSV (K1, K2). Spark commits whole tables (K3)."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{folder}/edges.parquet")
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}.tsv")


# Display colours by node type.
COLOURS = {"enzyme": "#e41a1c", "protein": "#377eb8", "glycan": "#4daf4a", "disease": "#984ea3", "variant": "#ff7f00", "compound": "#a65628", "site": "#f781bf"}


def colour(node_type: Column) -> Column:
    cases = [F.when(node_type == k, F.lit(v)) for k, v in COLOURS.items()]
    return F.coalesce(*cases, F.lit("#999999"))


def node_json(nodes: DataFrame) -> DataFrame:
    """(json): one line a node for display (K4)."""
    return nodes.select(F.to_json(F.struct(F.col("node_id").alias("id"), F.col("node_type").alias("type"), "label", colour(F.col("node_type")).alias("color"))).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation")).alias("json"))


def tooltip(label: Column, node_type: Column, metadata: Column) -> Column:
    """Label, type and metadata entries in one text."""
    entries = F.transform(F.map_entries(metadata), lambda e: F.concat_ws(": ", e.key, e.value))
    return F.concat_ws("\n", label, node_type, F.array_join(entries, "\n"))


def report_lines(report: DataFrame) -> DataFrame:
    """(line): report rows as Markdown table lines (K6)."""
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns)), F.lit(" |")).alias("line"))


def write_rejects(df: DataFrame, path: str) -> None:
    """Failed rows, for a later try (K7)."""
    df.write.mode("append").json(path)


def mapping_diagnostics(mapped: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Counts of mapped and unresolved rows, and the distinct unresolved keys (K8)."""
    counts = mapped.groupBy(F.when(F.col("mapped").isNull(), "unresolved").otherwise("mapped").alias("status")).agg(F.count("*").alias("n"))
    return counts, mapped.where("mapped is null").select(key).distinct()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder (K9)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _files(spark: SparkSession, path: str):
    """The store's file system for path, and its path class."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), of


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions of a table of replace_table(), oldest first."""
    fs, of = _files(spark, path)
    there = fs.listStatus(of(f"{path}/commits")) if fs.exists(of(f"{path}/commits")) else []
    return sorted(int(f.getPath().getName()) for f in there if f.getPath().getName().isdigit())


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), keep: int = 2) -> int:
    """Replace the table at path as a whole or not at all; the number of the new version (K3).

    The rows are written to a folder of their own, which nobody reads yet. A small commit file that
    names it is moved into place last, and readers go by the newest commit file, so a write that
    fails half-way, or a lost driver, leaves the old table as it is. df may read the old version.
    Of two writers at once the second fails. All but the newest `keep` versions are removed.
    """
    spark = df.sparkSession
    fs, of = _files(spark, path)
    done = versions(spark, path)
    version = (done[-1] if done else 0) + 1
    folder = f"data-{version}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    fs.mkdirs(of(f"{path}/commits"))
    pending = of(f"{path}/commits/.{folder}")
    out = fs.create(pending, False)
    out.write(bytearray(folder.encode()))
    out.close()
    final = of(f"{path}/commits/{version}")
    if fs.exists(final) or not fs.rename(pending, final):
        fs.delete(pending, False)
        fs.delete(of(f"{path}/{folder}"), True)
        raise RuntimeError(f"version {version} of {path} is another writer's")
    for old in done[: max(0, len(done) + 1 - keep)]:
        where = _folder(spark, path, old)
        fs.delete(of(f"{path}/commits/{old}"), False)
        fs.delete(of(f"{path}/{where}"), True)
    return version


def _folder(spark: SparkSession, path: str, version: int) -> str:
    return spark.read.text(f"{path}/commits/{version}").first()[0]


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest committed version of a table of replace_table(), or one that is still kept."""
    done = versions(spark, path)
    if not done or (version and version not in done):
        raise FileNotFoundError(f"{path} has no committed version" + (f" {version}" if version else ""))
    return spark.read.parquet(f"{path}/{_folder(spark, path, version or done[-1])}")
