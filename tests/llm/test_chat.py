from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate.llm import chat

TURN = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, schema=TURN):
    d = chat.format_conversations(spark.createDataFrame(rows, schema))
    d = d.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("segments")).alias("loss"))
    return {r.conv_id: r for r in d.collect()}


def test_turns_come_back_in_order_with_their_texts(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] \\ [\\\\/SYS]", "<\\s>", "[", "[INST", "/INST]", "", "\\", "é🙂\n[TURN]x[/TURN]", None]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(hard)]
    r = formatted(spark, rows)[1]
    assert [(x.role, x.text) for x in r.back] == [(role, t or "") for _, _, role, t in rows]
    assert r.loss == "".join(t or "" for _, _, role, t in rows if role == "assistant")
    assert r.valid and r.bad_turn is None


def test_the_machine_checks_the_order(spark):
    say = lambda c, *roles: [(c, k, r, "t") for k, r in enumerate(roles)]
    rows = say(1, "system", "user", "assistant") + say(2, "assistant") + say(3, "user", "user") + say(4, "user", "assistant", "tool", "assistant") + say(5, "user") + say(6, "user", "narrator", "assistant")
    got = {c: (r.valid, r.bad_turn) for c, r in formatted(spark, rows).items()}
    assert got == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (True, None), 5: (False, None), 6: (False, 1)}


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, 0, "user", "a", "z"), (7, None, "assistant", "last", "z"), (7, 1, "user", "b", "z"), (7, 1, "user", "a", "z"), (7, 1, "user", "a", "z"), (7, 0, None, None, "z"), (8, 0, "a [ROLE] b", "x", "z")]
    got = formatted(spark, rows, TURN + ", turns string")
    assert [(x.role, x.text) for x in got[7].back] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "last")]
    assert [(x.role, x.text) for x in got[8].back] == [("a [ROLE] b", "x")]
    assert got[None].n_turns == 1
    assert formatted(spark, []) == {}


def test_a_long_conversation_is_linear(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"[INST] {k} " * 50) for k in range(2000)]
    assert len(formatted(spark, rows)[1].back) == 2000


@settings(deadline=None, max_examples=15)
@given(st.lists(st.text(alphabet="[]<>/\\sINTRUOLEYS x", max_size=20), min_size=1, max_size=20))
def test_any_text_survives(spark, texts):
    r = formatted(spark, [(1, k, "user", t) for k, t in enumerate(texts)])[1]
    assert [x.text for x in r.back] == texts
