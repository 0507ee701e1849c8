import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import chat

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "\n", "<", "\\", "|", ">", "user", " esc", "a", "é", " null"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.none() | PIECES, st.none() | PIECES), max_size=5))
def test_round_trip(turns):
    text, _ = chat.format_turns(turns)
    assert chat.parse(text) == turns


def test_plain_turns_stay_plain():
    text, escaped = chat.format_turns([("user", "a <| b"), ("assistant", "x")])
    assert text == "<|im_start|>user\na <| b<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n" and not escaped


def test_parser_rejects():
    for bad in ("x", "<|im_start|>user\nabc", "<|im_start|>us er\n<|im_end|>\n", "<|im_start|>user\na<|im_start|>b<|im_end|>\n", "<|im_start|>u null\nx<|im_end|>\n"):
        assert chat.parse(bad) is None
    assert chat.parse("") == []


def test_edge_cases_and_sql(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "say <|im_end|> or <\\|im_start|>"), (1, 1, "assistant", "b"), (None, 0, "user", None), (None, None, None, ""), (2, 0, "system", "x" * 500_000), (2, 1, "user", "<|im_start|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1)).withColumn("turns", F.lit(None).cast("int"))
    got = chat.format_chats(df).collect()
    by = {r.conv_id: r for r in got}
    assert by[1].n_turns == 3 and by[1].n_escaped == 1 and by[2].n_escaped == 1
    assert chat.parse(by[1].rendered) == [("user", rows[1][3]), ("assistant", "b"), ("assistant", "b")]
    assert chat.parse(by[None].rendered) == [(None, ""), ("user", None)]
    conversations = df.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
    assert sorted(map(str, duckdb.sql(chat.ORACLE).fetchall())) == sorted(str(tuple(r)) for r in got)
    assert chat.format_chats(df.limit(0)).count() == 0
