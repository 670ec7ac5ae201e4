"""Expressions over identifiers, paths and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the third hyphen-separated part of a document id is its platform.
SOURCE_PART = r"^(?:[^-]+-){2}([^-]+)"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def source_of(docno: Column | str) -> Column:
    return F.nullif(F.regexp_extract(docno, SOURCE_PART, 1), F.lit(""))


def event_before_request_mark(request: Column | str) -> Column:
    """Text before the first '-r'."""
    return F.substring_index(request, "-r", 1)


def event_before_last_hyphen(request: Column | str) -> Column:
    """Text before the last '-', empty when there is none."""
    request = _column(request)
    return F.when(request.contains("-"), F.regexp_replace(request, "-[^-]*$", "")).otherwise("")


def last_path_part(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def after_first_slash(path: Column | str) -> Column:
    """Text after the first '/', empty when there is none."""
    path = _column(path)
    return F.when(path.contains("/"), F.regexp_replace(path, "^[^/]*/", "")).otherwise("")


def without_gz(name: Column | str) -> Column:
    return F.replace(name, F.lit(".gz"), F.lit(""))


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def split_ids(ids: Column | str) -> Column:
    return F.split(ids, ",")


def dataset_id(event: Column | str, date: Column | str, root: str = "") -> Column:
    """Path-like id of one collection: [root/]event/day."""
    parts = [F.lit(root)] if root else []
    return F.concat_ws("/", *parts, _column(event), _column(date).cast("string"))


def moment(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_column(seconds))


def day(seconds: Column | str) -> Column:
    return F.to_date(moment(seconds))


def moment_text(seconds: Column | str) -> Column:
    return F.date_format(moment(seconds), "yyyy-MM-dd HH:mm:ss")


def day_text(seconds: Column | str) -> Column:
    return F.date_format(moment(seconds), "yyyy-MM-dd")
