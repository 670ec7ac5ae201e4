"""An index that days are added to."""

from datetime import date

import pytest

from daydigest.operators import collection as C
from daydigest.operators import daily, ranking
from daydigest.sinks import writers

ROWS = [
    ("e", "d1", "a", "Fires burn in the hills", 1), ("e", "d1", "b", "hills and fires, fires", 2), ("f", "d1", "c", None, 3),
    ("e", "d2", "d", "the river floods", 4), ("f", "d2", "e", "burning fires", 5), ("f", "d2", "e", "burning fires", 5), ("f", "d3", "g", "", 6),
]


DAYS = {"d1": date(2020, 1, 1), "d2": date(2020, 1, 2), "d3": date(2020, 2, 1)}


def frame(spark, days):
    return spark.createDataFrame([(r[0], DAYS[r[1]], *r[2:]) for r in ROWS if r[1] in days], "event_id string, date date, docno string, text string, unix_timestamp long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_days_are_added_once_and_statistics_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    assert rows(daily.sizes(spark, path)) == []
    assert daily.add_days(frame(spark, ["d1"]), path) == 2
    built = []
    build = C.build_index
    monkeypatch.setattr(C, "build_index", lambda corpus, *a: built.append(corpus.count()) or build(corpus, *a))
    assert daily.add_days(frame(spark, ["d1", "d2"]), path) == 2
    assert daily.add_days(frame(spark, ["d1", "d2"]), path) == 0 and daily.add_days(frame(spark, ["d1"]), path) == 0
    assert daily.add_days(frame(spark, ["d3", "d1"]), path) == 1
    # only the new days' rows were read, and only new words were stemmed
    assert built == [3, 1]
    forms = daily.stored(spark, path, "forms", daily.FORMS, 3)
    assert forms.count() == forms.select("surface").distinct().count()
    whole = C.build_index(frame(spark, ["d1", "d2", "d3"]))
    grown = daily.open_index(spark, path)
    for mine, theirs in zip(C.index_statistics(grown), C.index_statistics(whole)):
        assert rows(mine) == rows(theirs)
    asked = spark.createDataFrame([("e", "q", "fire hills"), ("f", "q", "burn")], "event_id string, query_id string, indicative_terms string")
    calendar = spark.createDataFrame([(e, DAYS[d]) for e in "ef" for d in ("d1", "d2")], "event_id string, date date")
    ranked = [rows(ranking.rank_index(i, asked, calendar).select("q_id", "event_id", "date", "docno", "score", "rank")) for i in (grown, whole)]
    assert ranked[0] == ranked[1] and len(ranked[0]) == 4


def test_a_batch_that_fails_or_loses_the_race_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rename = daily.renamed_if_absent

    def other_first(spark_, staged, target):
        monkeypatch.setattr(daily, "renamed_if_absent", rename)
        daily.add_days(frame(spark, ["d1"]), path)
        return rename(spark_, staged, target)

    monkeypatch.setattr(daily, "renamed_if_absent", other_first)
    assert daily.add_days(frame(spark, ["d1", "d2"]), path) == 2
    assert daily.batches(spark, path) == 2 and daily.sizes(spark, path).count() == 4
    monkeypatch.setattr(daily, "renamed_if_absent", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        daily.add_days(frame(spark, ["d3"]), path)
    assert daily.batches(spark, path) == 2 and not writers.exists(spark, f"{path}/batch-2")
