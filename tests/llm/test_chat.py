from changelens.llm import catalog, chat
from tests.harness import compare, duck
from tests.llm.conftest import SF


def test_query_matches_sql(spark):
    name = "op6_chat_perspectives"
    assert compare(spark, duck(SF), name, catalog.QUERIES[name], catalog.ORACLES[name], SF)[0] is None


def test_every_seat_of_three_speakers(spark):
    rows = [(1, 0, "system", "rules", 0), (1, 1, "ann", "hi <|end|>", 0), (1, 2, "bob", "hey", 0), (1, 3, None, None, 0), (1, 4, "ann", "", 0), (1, None, "bob", "first", 0), (1, 4, "ann", "", 0),
            (None, 1, "cy", "x", 0), (2, 0, "system", "alone", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", -1), (1, "ann", 0), (1, "bob", -1), (1, "bob", 0), (None, "cy", 0)}
    whole = got[1, "ann", 0]
    assert whole["text"] == "<|system|>\nrules<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\nhey<|end|>\n<|user name=unknown|>\n<|end|>\n<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert [whole["text"][a:b] for a, b in whole["mask"]] == ["hi < |end|><|end|>\n", "<|end|>\n", "<|end|>\n"]
    assert whole["start"] == len(got[1, "ann", -1]["text"])
    assert chat.rotate(df.where("false")).collect() == []


def test_long_conversations_come_in_parts_that_join(spark):
    df = spark.createDataFrame([(1, i, "ab"[i % 2], f"turn {i}") for i in range(50)], "conv_id long, turn long, role string, text string")
    whole = {r["perspective"]: r for r in chat.rotate(df).collect()}
    for seat in "ab":
        parts = sorted((r for r in chat.rotate(df, part_turns=7).collect() if r["perspective"] == seat), key=lambda r: r["part"])
        assert "".join(r["text"] for r in parts) == whole[seat]["text"]
        assert [(r["start"] + m["start"], r["start"] + m["end"]) for r in parts for m in r["mask"]] == [tuple(m) for m in whole[seat]["mask"]]


def test_crowded_spans_come_in_bounded_rows(spark):
    rows = [(None if i % 3 else 1, None if i % 2 else i % 4, "abc"[i % 3 - (i % 7 == 0)], f"text {i % 11}" + "x" * (300 * (i % 5 == 0))) for i in range(400)] + [(2, 0, "a", "one"), (2, 1, None, "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    got = {}
    for r in chat.rotate(df, part_turns=16).collect():
        assert r["n_turns"] <= 16
        got.setdefault((r["conv_id"], r["perspective"], r["part"]), []).append(r)
    assert got.keys() == whole.keys() and max(map(len, got.values())) > 5
    for key, parts in got.items():
        parts.sort(key=lambda r: r["start"])
        assert "".join(r["text"] for r in parts) == whole[key]["text"] and parts[0]["start"] == whole[key]["start"]
        assert all(a["start"] + len(a["text"]) == b["start"] for a, b in zip(parts, parts[1:]))
        assert [r["text"][a:b] for r in parts for a, b in r["mask"]] == [whole[key]["text"][a:b] for a, b in whole[key]["mask"]]
