import duckdb

from lexicrate.llm.chat import OP3_SQL, format_preferences, op3_chat_formatting

PAIRS = "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt_id int"


def rendered(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        whole = rendered([(r, t)])
        if r == "assistant":
            out.append((at + len(f"<|{r}|>\n"), at + len(whole) - 1))
        at += len(whole)
    return out


def test_pairs(spark):
    u, a, b = ("user", "hé?"), ("assistant", "yes"), ("assistant", "no")
    cases = [
        ([u, a], [u, b]), ([u, a, u, b], [u, a, u, a]), ([], [u]), ([u], [u]), ([a, u], [b, u]),
        ([u, (None, None), a], [u, (None, None), b, u, a]),
    ]
    rows = [(i, x, y, 1) for i, (x, y) in enumerate(cases)] + [(99, None, [u, a], 1)]
    out = {r.id: r for r in format_preferences(spark.createDataFrame(rows, PAIRS)).collect()}
    for i, x, y, _ in rows:
        x = x or []
        n = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        r = out[i]
        assert (r.n_common, r.prompt) == (n, rendered(x[:n]))
        assert (r.chosen, r.rejected) == (rendered(x[n:]), rendered(y[n:]))
        assert [tuple(s) for s in r.chosen_mask] == spans(x[n:])
        assert [tuple(s) for s in r.rejected_mask] == spans(y[n:])
        assert r.prompt_id == 1


def test_clashing_columns(spark):
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], 7)]
    df = spark.createDataFrame(rows, PAIRS)
    names = ["_a", "_b", "_p", "n_common", "prompt", "chosen_mask", "left_turns", "common_turns", "right_turns"]
    out = format_preferences(df.selectExpr("*", *[f"'mine' as {c}" for c in names]))
    assert out.columns == [
        "id", "prompt_id", "_a", "_b", "_p", "left_turns", "common_turns", "right_turns",
        "n_common", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask",
    ]
    assert out.first().n_common == 1 and out.first()._a == "mine"


def test_query_equals_sql(spark, tmp_path):
    rows = [
        (0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d"), (1, 2, "user", "e"),
        (2, 0, "user", "x"), (3, 0, "user", "x"), (3, 1, "assistant", None), (4, 0, None, "q"), (4, None, "assistant", "z"),
        (6, 0, "assistant", "same"), (7, 0, "assistant", "same"), (8, 1, "user", "t"), (8, 1, "user", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = op3_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(OP3_SQL)
    assert want.columns == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(want.fetchall())
    empty = tmp_path / "none"
    df.limit(0).write.parquet(str(empty / "conversations.parquet"))
    assert op3_chat_formatting(spark, str(empty)).count() == 0
