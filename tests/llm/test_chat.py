import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[/OUT]", "[TURN]", "[ROLE]", "[/ROLE]", "<", "[", "]", "/", chat.MARK, "a", "é😀", "\n", "$1", "\\", "S"]
TEXT = st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=7).map("".join))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[/ROLE]", "", None]), TEXT), min_size=1, max_size=6), min_size=25, max_size=40))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text, "x") for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted string").repartition(4)
    out = chat.format_chats(turns)
    read = out.select("conv_id", "formatted", "loss_spans", chat.parsed_turns(out.formatted).alias("turns"), chat.masked_text(out.formatted, out.loss_spans).alias("loss")).collect()
    assert len(read) == len(chats)
    for r in read:
        want = [(role or "", text or "") for role, text in chats[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(x for role, x in want if role == "assistant")
        merged = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
        assert r.formatted.count("</s>") == merged


def test_digests(spark, sf_dir):
    got = {r.conv_id: r for r in chat.op10_chat_formatting(spark, sf_dir).collect()}
    r = got[-7]
    p = chat.PROBE
    assert r.n_turns == 2 and r.loss_chars == len(p) and r.loss_sha256 == hashlib.sha256(p.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{p}\nassistant\n{p}\n".encode()).hexdigest()


def test_null_ties_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "b"), (None, 1, "user", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = {r.conv_id: r.formatted for r in chat.format_chats(turns).collect()}
    assert out == {None: "<s>[ROLE][/ROLE]</s><s>[INST]a[TURN]b[/INST]</s>", 1: "<s>[OUT]a[TURN]a[/OUT]</s>"}
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_conversations_cost_in_proportion(spark):
    """A conversation of twice the turns takes about twice the time, and its spans are right to the end."""
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"))
        begun = time.time()
        r = chat.format_chats(turns).select("formatted", "loss_spans").first()
        spent = time.time() - begun
        for i in (0, 1, n // 2, n - 1):
            start, length = r.loss_spans[i]
            assert r.formatted[start : start + length] == f"text {i}"
        return spent

    seconds(2000)
    short = min(seconds(20_000) for _ in range(2))
    assert min(seconds(40_000) for _ in range(2)) < 2.5 * short + 1
