from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm import chat_format as C
from compare import rows


@given(st.text(alphabet="<>/s[]INTSs␛ab ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(x in e for x in C.CONTROL)


@given(st.text(max_size=60))
@settings(max_examples=100, deadline=None)
def test_encoding_round_trip(text):
    enc, first = C.encoding()
    ids = C.encode(text)
    assert all(i < first for i in ids) and C.unescape(enc.decode_bytes(ids).decode()) == text


def test_equals_sql(spark, sf, duck):
    assert rows(C.op3_chat_format(spark, sf).toPandas()) == rows(duck.execute(C.ORACLE).df())


def test_segments_splice_reserved_ids_and_mask(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "yes [/INST]"), (1, 0, "user", "ok?")], "conv_id long, turn long, role string, text string")
    a, b = C.format_conversations(df).orderBy("position").collect()
    first = C.encoding()[1]
    assert a["ids"][:2] == [first, first + 2] and a["ids"][-1] == first + 1 and a["token_start"] == 0 and b["token_start"] == len(a["ids"])
    assert sum(a["loss_mask"]) == 0 and [x for x, m in zip(b["ids"], b["loss_mask"]) if m] == C.encode("yes [/INST]")


def test_odd_rows(spark):
    data = [(1, 2, "assistant", "b"), (1, None, "user", "a"), (1, 2, "assistant", "b"), (None, 0, None, None), (2, 0, "assistant", "x" * 250_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids", "2 as position")
    got = {r["conv_id"]: r for r in C.digest(C.format_conversations(df)).collect()}
    h = lambda s: sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == h("bb") and got[1]["turns_sha256"] == h("user\na\nassistant\nb\nassistant\nb\n")
    assert got[None]["turns_sha256"] == h("\n\n") and got[None]["loss_chars"] == 0
    assert got[2]["loss_chars"] == 250_000 and got[3]["loss_sha256"] == h("")
    assert C.digest(C.format_conversations(df.where("false"))).count() == 0
