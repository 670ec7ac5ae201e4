"""Writers of results, facts and published tables."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def result_name(model: str, rerank: str, summarised: bool) -> str:
    return f"{model}_{rerank}_{'summary' if summarised else 'nosum'}.csv"


def arrays_as_json(df: DataFrame) -> DataFrame:
    """CSV holds no arrays; they are written as JSON text and read back by from_json."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    return df.withColumns({name: F.to_json(name) for name in lists})


# Characters that end or split a line, and what stands for them in a table of one line a record.
LINE_MARKS = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}


def on_one_line(df: DataFrame) -> DataFrame:
    """String columns without line breaks: a backslash, a line feed and a carriage return are written out."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]

    def marked(column: Column) -> Column:
        for mark, written in LINE_MARKS.items():
            column = F.replace(column, F.lit(mark), F.lit(written))
        return column

    return df.withColumns({name: marked(F.col(name)) for name in texts})


def with_line_breaks(df: DataFrame) -> DataFrame:
    """``on_one_line`` undone."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]

    def plain(column: Column) -> Column:
        # a written backslash is kept apart while the others are read
        column = F.replace(column, F.lit("\\\\"), F.lit("\\\0"))
        for mark in ("\n", "\r"):
            column = F.replace(column, F.lit(LINE_MARKS[mark]), F.lit(mark))
        return F.replace(column, F.lit("\\\0"), F.lit("\\"))

    return df.withColumns({name: plain(F.col(name)) for name in texts})


def write_csv(df: DataFrame, path: str, one_line: bool = False) -> str:
    """With ``one_line`` every record is one line, so that readers can split the files; see ``on_one_line``."""
    rows = arrays_as_json(df)
    writer = (on_one_line(rows) if one_line else rows).write.option("header", True).option("escape", '"')
    # texts keep their outer blanks
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_named_csv(df: DataFrame, folder: str, model: str, rerank: str, summarised: bool) -> str:
    """Save a result under its model, reranker and summary choice."""
    return write_csv(df, f"{folder.rstrip('/')}/{result_name(model, rerank, summarised)}")


def facts(summarised: DataFrame, text: str = "summary") -> DataFrame:
    """One fact of seven fields per grouped row."""
    return summarised.select(
        F.col("request_id").alias("requestID"),
        F.col(text).alias("factText"),
        F.col("unix_timestamp").cast("long").alias("unixTimestamp"),
        F.col("avg_importance").cast("double").alias("importance"),
        F.col("docno_list").alias("sources"),
        F.lit(None).cast("string").alias("streamID"),
        F.col("q_id").alias("informationNeeds"),
    )


def write_facts(df: DataFrame, path: str, gzip: bool = True, by_run: bool = False) -> str:
    """JSON Lines with the null field kept, gzipped unless asked otherwise."""
    writer = df.write.option("ignoreNullFields", False)
    if gzip:
        writer = writer.option("compression", "gzip")
    if by_run:
        writer = writer.partitionBy("run_id")
    writer.json(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``, in any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def renamed_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder to a name that nothing has yet, in one step of the store; False if something has it."""
    jvm = spark._jvm
    here, there = (jvm.org.apache.hadoop.fs.Path(path) for path in (source, target))
    store = here.getFileSystem(spark._jsc.hadoopConfiguration())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(store.makeQualified(here), store.makeQualified(there), no_options)
    except Py4JJavaError as refused:
        if not exists(spark, target):
            raise
        if "Exist" not in refused.java_exception.getClass().getSimpleName() and exists(spark, source):
            raise
        return False
    return True


def insert_if_absent(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write a table only when nothing is there yet.

    The table is written beside its place and moved there whole: readers see all of it or nothing, a writer that fails
    leaves its place free, and of several writers the first to finish wins and the others' rows go.
    """
    spark = df.sparkSession
    if exists(spark, path):
        return path
    parent, name = path.rstrip("/").rsplit("/", 1)
    staged = f"{parent}/_{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    try:
        writer.parquet(staged)
        renamed_if_absent(spark, staged, path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(staged)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return path


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)
