"""Text, stemming and identifier expressions."""

from pyspark.sql import functions as F

from daydigest.functions import ids
from daydigest.functions import text as T
from daydigest.functions.porter import porter_stem

# samples printed in the 1980 paper and a few edge words
STEMS = """
caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good
revival reviv allowance allow airliner airlin adjustable adjust replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil being be by by yes ye
""".split()


def test_porter_samples(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame(pairs, "word string, expected string")
    wrong = df.withColumn("got", porter_stem("word")).filter("got <> expected").collect()
    assert wrong == []


def test_tokens_are_whole_runs(spark):
    df = spark.createDataFrame(
        [("Fire-line, 2017! aaaab 1a2b3c4d5 " + "x" * 21 + " 12345 ok",), ("",), (None,)], "t string"
    )
    rows = [r[0] for r in df.select(T.tokens("t")).collect()]
    assert rows == [["fire", "line", "2017", "aaaab", "1a2b3c4d5", "x" * 21, "12345", "ok"], [], None]


def test_stop_words_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("the fire and The fire of hills",)], "t string")
    assert df.select(T.terms_without_stop_words("t")).first()[0] == ["fire", "fire", "hills"]


def test_clean_social_and_joins(spark):
    df = spark.createDataFrame([("go #fire now https://x.y/z @me end",)], "t string")
    assert df.select(T.clean_social("t")).first()[0] == "go  now   end"
    listed = F.array(F.lit("One."), F.lit("Two"))
    assert df.select(T.joined_with_dots(listed)).first()[0] == "One. Two"


def test_prompt_holds_text_and_question(spark):
    df = spark.createDataFrame([("some text", "where")], "t string, q string")
    made = df.select(T.prompt(F.col("t"), F.col("q"))).first()[0]
    assert "some text\n" in made and "where?\n" in made and '"unanswerable"' in made


def test_ids(spark):
    df = spark.createDataFrame(
        [("A-1-Twitter-9-2", "A-001-r3"), ("A-1", "plain")], "docno string, request string"
    )
    rows = df.select(
        ids.source_of("docno").alias("source"),
        ids.event_before_request_mark("request").alias("r"),
        ids.event_before_last_hyphen("request").alias("last"),
    ).collect()
    assert [tuple(r) for r in rows] == [("Twitter", "A-001", "A-001"), (None, "plain", "")]


def test_paths_and_times(spark):
    df = spark.createDataFrame([("submissions/run.json.gz", 1512604800)], "f string, s long")
    row = df.select(
        ids.without_gz(ids.after_first_slash("f")).alias("run"),
        ids.last_path_part("f").alias("name"),
        ids.file_stem(F.lit("summary.csv")).alias("stem"),
        ids.moment_text("s").alias("moment"),
        ids.day_text("s").alias("day"),
        ids.dataset_id("f", F.lit("2017-12-07").cast("date"), "root").alias("dataset"),
    ).first()
    assert tuple(row) == (
        "run.json",
        "run.json.gz",
        "summary",
        "2017-12-07 00:00:00",
        "2017-12-07",
        "root/submissions/run.json.gz/2017-12-07",
    )
