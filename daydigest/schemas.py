"""Schemas of the input and output tables."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


EVENT_DIM = StructType(_strings("event_id", "event_name"))

TOPICS = StructType(
    _strings("eventID", "trecisID", "dataset", "title", "type", "url", "description")
)

DAY_RECORDS = ArrayType(StructType(_strings("eventID", "requestID", "dateString")))

QUERIES = StructType(
    _strings(
        "query_id",
        "text",
        "indicative_terms",
        "trecis_category_mapping",
        "event_id",
        "event_title",
        "event_dataset",
        "event_description",
        "event_trecis_id",
        "event_type",
        "event_url",
    )
)

CORPUS = StructType(
    _strings("docno", "event", "text", "source", "source_type")
    + [StructField("unix_timestamp", LongType())]
    + _strings("event_id")
    + [StructField("date", DateType())]
)

FACTS = StructType(
    _strings("requestID", "factText")
    + [
        StructField("unixTimestamp", LongType()),
        StructField("importance", DoubleType()),
        StructField("sources", ArrayType(StringType())),
    ]
    + _strings("streamID", "informationNeeds")
)

GROUPED_CSV = StructType(
    _strings("request_id", "q_id", "Event", "event_title", "texts", "docno_list")
    + [StructField("avg_importance", DoubleType()), StructField("unix_timestamp", LongType())]
    + _strings("question", "query")
)
