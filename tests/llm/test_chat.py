import hashlib

import duckdb
import pytest

from tableprep.llm import chat as C

SF = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string"
ROWS = [(1, 0, "system", "be [kind]"), (1, 1, "user", "a b c"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", "x " * 40),
        (1, 4, "assistant", "back\\slash \\l \\b <tag> \\"), (1, 5, "user", None), (1, 6, "assistant", ""), (2, 0, None, "only"), (None, 1, "assistant", "n"),
        (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (4, 0, "system", "s"), (5, 0, "user", "w " * 5000),
        (5, 1, "assistant", "v " * 30), (6, 1, "assistant", "one"), (6, 0, "assistant", "zero"), (7, 0, "we]ird[", "q")]


def turns_of(rows):
    key = lambda r: tuple((x is not None, x) for x in (r[1], r[2] or "", r[3] or ""))
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.mark.parametrize("budget", [C.WindowBudget(), C.WindowBudget(6, 2, 5), C.WindowBudget(40, 3, 100), C.WindowBudget(2, 1, 1)])
def test_round_trip_and_budget(spark, budget):
    df = spark.createDataFrame(ROWS, TURN).selectExpr("*", "7 AS win", "8 AS seq", "9 AS formatted")
    windows = C.format_windows(df, budget)
    back = {r["conv_id"]: r for r in C.read_back(windows).collect()}
    want = turns_of(ROWS)
    assert back.keys() == want.keys()
    for conv, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == turns
        assert back[conv]["loss_texts"] == [t for r, t in turns if r == "assistant"]
    for w in windows.collect():
        parts = w["formatted"].split(C.END)[:-1]
        own = [len(p.split("]", 1)[1].split()) + 1 for p in parts[w["n_repeated"]:] if not p.startswith("[system]")]
        assert len(own) <= 1 or sum(own) <= budget.span_tokens
        repeated = [p for p in parts[:w["n_repeated"]] if not p.startswith("[system]")]
        assert len(repeated) <= budget.history_turns and sum(len(p.split("]", 1)[1].split()) + 1 for p in repeated) <= budget.history_tokens
        if w["conv_id"] == 1:
            assert parts[0] == "[system]be \\okind\\c"
        for s in w["loss"]:
            assert "[" not in w["formatted"][s["start"]:s["start"] + s["length"]] and "<" not in w["formatted"][s["start"]:s["start"] + s["length"]]


def test_empty_table(spark):
    assert C.read_back(C.format_windows(spark.createDataFrame([], TURN))).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(C.ORACLE["op9_budgeted_windows"]).df().sort_values("conv_id").reset_index(drop=True)
    got = C.op9_budgeted_windows(spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(got)].astype(str))
    extra = got[got.conv_id == -1].iloc[0]
    says = "</s>[INST] ok [/INST]"
    assert extra.turns_sha256 == hashlib.sha256(f"user\n{says}\nassistant\n{says}\n".encode()).hexdigest()
    assert (extra.loss_chars, extra.loss_sha256) == (len(says), hashlib.sha256(says.encode()).hexdigest())


def test_long_conversation(spark):
    """Thousands of turns make many windows, each within the budget; every turn is read back once, in order."""
    rows = [(9, 0, "system", "be brief")] + [(9, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "word " * (i % 37)) for i in range(1, 4000)]
    windows = C.format_windows(spark.createDataFrame(rows, TURN))
    back = C.read_back(windows).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r[2], r[3]) for r in rows]
    assert back["loss_texts"] == [r[3] for r in rows if r[2] == "assistant"]
    got = windows.collect()
    assert len(got) > 300 and all(w["formatted"].startswith("[system]be brief") for w in got)
