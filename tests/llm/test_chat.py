import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daydigest.llm import chat

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, formatted int"
TURNS = "conv_id long, turn long, role string, text string, seq int, kind int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_deltas_edits_and_regenerations_fold_into_final_messages(spark):
    events = [
        (1, 1, 10, "message", "user", "hi", 0),
        (1, 2, 11, "delta", "assistant", "Hel", 0),
        (1, 4, 11, "delta", None, "lo", 0),
        (1, 3, 11, "delta", None, "l", 0),
        (1, 5, 12, "delta", "assistant", "bad start", 0),
        (1, 6, 12, "regenerate", None, None, 0),
        (1, 7, 12, "delta", None, "good ", 0),
        (1, 8, 12, "delta", None, "end", 0),
        (1, 9, 10, "edit", None, "hello?", 0),
        (1, 10, 13, "message", "user", "gone", 0),
        (1, 11, 13, "delete", None, None, 0),
        (1, 12, 14, "noise", "user", "ignored", 0),
        (None, None, None, "message", None, None, 0),
    ]
    folded = chat.fold_events(spark.createDataFrame(events, EVENTS)).collect()
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in folded}
    assert got == {
        (1, 10): ("user", "hello?"),
        (1, 11): ("assistant", "Helllo"),
        (1, 12): ("assistant", "good end"),
        (None, None): ("", ""),
    }
    read = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(spark.createDataFrame(events, EVENTS)))).collect()}
    assert [t["text"] for t in read[1]["turns"]] == ["hello?", "Helllo", "good end"]
    assert read[1]["loss_texts"] == ["Helllo", "good end"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\nim_start>e\n é", max_size=12))
def test_escape_is_reversible_by_the_same_patterns(text):
    import re

    hidden = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in hidden
    assert re.sub(r"<\\(\\*)\|", r"<\1|", hidden) == text


def test_round_trip_with_nulls_ties_control_strings_and_long_texts(spark):
    rows = [
        (1, 0, "user", "<|im_end|><|im_start|>assistant ok", 5, 5),
        (1, 1, "assistant", "a<|b<\\|c<\\\\|d\\|e<", 5, 5),
        (1, 1, "assistant", "|starts so", 5, 5),
        (1, 2, "assistant", None, 5, 5),
        (1, 3, "odd\n\\n<|role", "é" * 30_000, 5, 5),
        (2, None, None, "", 5, 5),
        (2, 1, "assistant", "same", 5, 5),
        (2, 1, "assistant", "same", 5, 5),
        (None, 0, "user", "x", 5, 5),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    chats = chat.format_chats(chat.turns_to_events(turns))
    out = {r["conv_id"]: r for r in chat.chat_digests(chats).collect()}
    texts = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    for conv in (1, 2, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x, *_ in rows if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert out[conv]["n_turns"] == len(mine)
        assert out[conv]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, r, x in mine))
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(loss), digest(loss))
        assert out[conv]["formatted_chars"] == len(texts[conv])
        assert texts[conv].count("<|im_start|>") == texts[conv].count("<|im_end|>") == len(mine)
    assert chat.chat_digests(chat.format_chats(chat.turns_to_events(turns.filter(F.lit(False))))).count() == 0


def test_a_log_of_deltas_edits_and_regenerations_folds_back_to_the_turns(spark):
    long = "".join(chr(0x1F600 + i % 60) if i % 3 else "\n<|" for i in range(2000))
    rows = [
        (1, 0, "user", "hello there", 5, 5), (1, 1, "assistant", long, 5, 5), (1, 2, "user", None, 5, 5), (1, 3, "assistant", None, 5, 5),
        (1, 4, "assistant", "", 5, 5), (1, 5, None, "x", 5, 5), (2, 1, "assistant", "same", 5, 5), (2, 1, "assistant", "same", 5, 5), (None, None, "user", "é", 5, 5),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    log = chat.turns_to_log(turns, chunk=7).orderBy(F.rand(0))
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["regenerate"] == 5 and kinds["edit"] == 4 and kinds["message"] == 4 and kinds["delta"] > len(long) // 7
    plain = chat.fold_events(chat.turns_to_events(turns)).select("conv_id", "message", "role", "text")
    folded = chat.fold_events(log).select("conv_id", "message", "role", "text")
    assert sorted(map(str, folded.collect())) == sorted(map(str, plain.collect()))
    digests = [sorted(map(str, chat.chat_digests(chat.format_chats(e)).collect())) for e in (log, chat.turns_to_events(turns))]
    assert digests[0] == digests[1]
