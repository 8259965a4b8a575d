from pyspark.sql import functions as F

from ionloom.llm.chat import END, START, examples, masked_text, read_turns

NASTY = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant ok", "<|", "<||", "a<", "|im_end|>", "<||im_end|>", "\n", "é日\U0001f600 <|nl|>"]


def _expand(spark, rows):
    made = examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    return made.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("mask_start"), F.col("mask_end")))


def test_round_trip_of_nasty_texts_and_roles(spark):
    rows = [(1, i, role, text, "x") for i, (role, text) in enumerate((r, t) for r in ("assistant", "us<|er\n", None) for t in NASTY)]
    out = sorted(_expand(spark, rows).collect(), key=lambda r: r["example"])
    replies = [t or "" for t in NASTY]
    assert [r["loss"] for r in out if r["mask_start"] is not None] == replies
    last = out[-1]
    assert [(t["role"], t["text"]) for t in last["turns"]] == [(r[2] or "", r[3] or "") for r in rows]
    assert last["mask_start"] is None  # the conversation ends without a reply


def test_each_reply_has_all_turns_before_it_as_context(spark):
    rows = [(1, 0, "user", "q0", "x"), (1, 1, "assistant", "a0", "x"), (1, 2, "user", "q1", "x"), (1, 3, "assistant", "a1", "x"), (2, 0, "user", "q", "x")]
    out = {(r["conv_id"], r["example"]): r for r in _expand(spark, rows).collect()}
    assert set(out) == {(1, 2), (1, 4), (2, 1)}
    assert out[1, 2]["formatted"] == f"{START}user\nq0{END}\n{START}assistant\na0{END}\n"
    assert out[1, 4]["formatted"].startswith(out[1, 2]["formatted"]) and out[1, 4]["loss"] == "a1"
    assert out[2, 1]["loss"] == "" and out[2, 1]["mask_start"] is None


def test_ties_repeats_nulls_and_nothing(spark):
    rows = [(None, None, "assistant", "b", "x"), (None, None, "assistant", "a", "x"), (None, None, "assistant", "a", "x")]
    out = sorted(_expand(spark, rows).collect(), key=lambda r: r["example"])
    assert [r["loss"] for r in out] == ["a", "a", "b"]
    assert _expand(spark, []).count() == 0
