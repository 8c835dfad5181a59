"""Sources: file discovery, explicit-schema measurement reads, logs and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapair.operators.ingest import match_names, parse_log

MEASUREMENT = "tag string, gen_idx bigint, K string, rho double"
MANIFEST = "device string, split string, idx bigint, path string"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def discover_files(spark: SparkSession, root: str, rules: list[tuple[str, str]], glob: str = "*") -> DataFrame:
    """List files and parse their names; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return match_names(files.select("path", "length"), "path", rules)


def read_contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "content")


def read_measurements(spark: SparkSession, path: str, schema: str = MEASUREMENT, fmt: str = "csv") -> DataFrame | None:
    """A measurement table with its declared schema, so device codes stay strings; None when absent."""
    if not path_exists(spark, path):
        return None
    reader = spark.read.schema(schema)
    return reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def root_status(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """name, status (OK or SKIP), rows: an absent root is a SKIP row, not a failure."""
    out = None
    for name, path in paths.items():
        if path_exists(spark, path):
            part = spark.read.format(fmt).load(path).agg(F.count(F.lit(1)).alias("n_rows"))
            part = part.select(F.lit(name).alias("name"), F.lit("OK").alias("status"), "n_rows")
        else:
            part = spark.range(1).select(F.lit(name).alias("name"), F.lit("SKIP").alias("status"), F.lit(None).cast("long").alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Progress lines of training logs, with the file they came from."""
    text = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    return parse_log(text, "value").drop("value")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested result documents, one per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)
