"""Readers of run files, grouped results and folders of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daydigest import schemas
from daydigest.functions import ids
from daydigest.sinks.writers import with_line_breaks


def run_of_path(path: Column) -> Column:
    """Run id of a file: its run_id=.. folder if it lies in one, else its name without .gz."""
    folder = F.regexp_extract(path, r"/run_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(ids.without_gz(ids.last_path_part(path)))


def read_runs(spark: SparkSession, path: str, schema=schemas.FACTS) -> DataFrame:
    """Gzipped JSON Lines facts with the run they belong to."""
    facts = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    return facts.withColumn("run_id", run_of_path(F.col("_metadata.file_path")))


def read_grouped(spark: SparkSession, path: str) -> DataFrame:
    """Grouped results saved as CSV; the document list is parsed back to an array."""
    reader = spark.read.schema(schemas.GROUPED_CSV).option("header", True).option("escape", '"')
    grouped = reader.option("multiLine", True).csv(path)
    return grouped.withColumn("docno_list", F.from_json("docno_list", "array<string>"))


def csv_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name (file stem) -> path, for every ``*.csv`` file or Spark CSV folder.

    Only file names are listed, no content; a folder holds one entry per table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_extract("path", r"/([^/]+\.csv)(?:/[^/]*)?$", 1)
    names = files.select(below.alias("name")).filter("name <> ''").distinct()
    return {
        row["name"][: -len(".csv")]: f"{folder.rstrip('/')}/{row['name']}"
        for row in names.orderBy("name").toLocalIterator()
    }


def read_csv_table(spark: SparkSession, path: str, schema=None, one_line: bool = False) -> DataFrame:
    """A CSV table with a header. Quoted line breaks make a file one task's; with ``one_line`` (a table of ``write_csv``
    a record a line) files are split."""
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("lineSep", "\n") if one_line else reader.option("multiLine", True)
    table = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return with_line_breaks(table) if one_line else table


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
