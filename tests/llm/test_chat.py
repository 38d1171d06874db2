import hashlib

import pytest
from pyspark.sql import functions as F

from waywarden.llm import chat

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
TEXTS = ["plain", "", r"\l \\l \\\ <", "<turn>x<text>y</turn>", r"\### Assistant: </turn> ok", "a\nb", "\\", "<", "é😀<", "x" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_escape_is_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).head()
    assert r["u"] == text and "<" not in r["e"]


def test_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 3, 1, "delta", None, "!"), (1, 2, 1, "delta", None, "lo"), (1, 4, 0, "edit", None, "Hey"), (1, 5, 1, "regenerate", "assistant", "New"),
        (1, 6, 1, "delta", None, " one"), (2, 0, 0, None, "user", None), (None, 0, 0, "message", "user", "nobody"),
    ]
    out = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()}
    assert out == {(1, 0): ("user", "Hey"), (1, 1): ("assistant", "New one"), (2, 0): ("user", ""), (None, 0): ("user", "nobody")}


def test_render_parses_back_with_its_mask(spark):
    rows = [(7, i, i, "message", ("user", "assistant", "system<")[i % 3], t) for i, t in enumerate(TEXTS)]
    out = chat.format_chats(spark.createDataFrame(rows, EVENTS))
    r = out.select("formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns")).head()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[4], x[5]) for x in rows]
    marked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    plain = lambda e: "\\".join(p.replace("\\l", "<") for p in e.split("\\\\"))
    assert [plain(m) for m in marked] == [x[5] for x in rows if x[4] == "assistant"]


def test_repeated_turns_stay(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in chat.op6(spark, str(tmp_path)).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nassistant\n\n").hexdigest() and out[1]["loss_chars"] == 0
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_sha256"] == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()


def test_empty_log(spark):
    assert chat.format_chats(spark.createDataFrame([], EVENTS)).count() == 0


def folded(rows):
    """The fold event by event."""
    state = {}
    rank = lambda e: (e[0] is not None, e[0] or 0, e[1], e[2] == "delta", e[4] or "", e[3] or "")
    for conv, seq, message, kind, role, text in sorted(rows, key=lambda e: rank((e[0], e[1], e[3], e[4], e[5]))):
        turns = state.setdefault(conv, {})
        if kind == "regenerate":
            for m in [m for m in turns if m > message]:
                del turns[m]
        was_role, was = turns.get(message, ("", ""))
        turns[message] = (role or was_role, was + (text or "") if kind == "delta" else text or "")
    return {(c, m): v for c, turns in state.items() for m, v in turns.items()}


def test_fold_equals_brute_force_in_any_order(spark):
    import random

    rng, rows = random.Random(3), []
    for conv in range(30):
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None])
            rows.append((conv, seq, rng.randrange(5), kind, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bc", "", None, "é<"])))
    rng.shuffle(rows)
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame(rows, EVENTS).repartition(5)).collect()}
    assert got == folded(rows) and len(got) > 60


def test_the_log_folds_back_to_its_turns(spark):
    rows = [(c, m, ("user", "assistant")[m % 2], TEXTS[(c + m) % len(TEXTS)] * (1 + c % 3)) for c in range(25) for m in range(1, 1 + c % 7)] + [(99, 1, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    log = chat.as_log(turns)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("message", "delta", "edit", "regenerate")) >= 10
    # answers that a regeneration drops are in the log
    assert log.filter("kind = 'message'").count() > len(rows)
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold_events(log.orderBy(F.rand(1))).collect()}
    assert got == {(c, m): (r or "", t or "") for c, m, r, t in rows}


def test_a_long_conversation(spark):
    turns = spark.range(3000).selectExpr("5L AS conv_id", "id + 1 AS message", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('<', id, '> '), 40) AS text")
    r = chat.format_chats(chat.as_log(turns)).select("formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert len(r) == 1 and len(r[0]["turns"]) == 3000 and r[0]["turns"][2999]["text"] == "<2999> " * 40
    s = r[0]["loss_spans"][-1]
    assert len(r[0]["loss_spans"]) == 1500 and r[0]["formatted"][s["start"] : s["start"] + s["length"]] == "\\l2999> " * 40


def test_entry_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], TEXTS[(c * t) % len(TEXTS)] if (c + t) % 7 else None, 1) for c in range(20) for t in range(c % 6)]
    spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string, kind int").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(chat.ORACLE)
    assert sorted(chat.op6(spark, str(tmp_path)).select(*want.columns).collect()) == sorted(want.fetchall())
