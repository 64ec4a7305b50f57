"""Chat logs, their fold, the template and what is read back, against plain versions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longtally.llm import chat, queries

from .helpers import SF, rows_of

LOG = "conv_id long, seq long, event string, message long, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"
RANK = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}


def plain_fold(events):
    """One event after another."""
    logs = {}
    for e in sorted({e for e in events if e[2] in RANK}, key=lambda e: (e[1], RANK[e[2]], e[5] or "", e[4] or "")):
        conv, _, event, message, role, text = e
        state = logs.setdefault(conv, {})
        if event == "open":
            state[message] = [role, ""]
        elif event == "regenerate":
            if message in state:
                state[message][1] = ""
            for later in [m for m in state if m > message]:
                del state[later]
        elif message in state:
            state[message][1] = (text or "") if event == "edit" else state[message][1] + (text or "")
    return sorted((c, m, r, t) for c, state in logs.items() for m, (r, t) in state.items())


def test_fold_of_random_logs(spark):
    rng = random.Random(5)
    events = []
    for conv in range(60):
        for seq in range(rng.randint(1, 40)):
            event = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate", "typing"])
            events.append((conv, seq, event, rng.randint(0, 5), rng.choice(["user", "assistant"]) if event == "open" else None, rng.choice(["a ", "b", "", None, "</s>"])))
    sent = events + rng.sample(events, 50)
    rng.shuffle(sent)
    log = spark.createDataFrame(sent, LOG).repartition(6).withColumn("opened", F.lit("extra"))
    assert rows_of(chat.reconstruct(log), "conv_id", "message", "role", "text") == sorted(plain_fold(events), key=repr)
    assert chat.reconstruct(log.limit(0)).count() == 0


def test_late_edit_and_regeneration(spark):
    log = [
        (1, 0, "open", 0, "user", None), (1, 1, "delta", 0, None, "hel"), (1, 2, "delta", 0, None, "lo"),
        (1, 3, "open", 1, "assistant", None), (1, 4, "delta", 1, None, "bad"), (1, 5, "open", 2, "user", None), (1, 6, "delta", 2, None, "why"),
        (1, 7, "edit", 0, None, "hello!"), (1, 8, "regenerate", 1, None, None), (1, 9, "delta", 1, None, "good"), (1, 10, "delta", 2, None, "lost"),
    ]
    got = chat.reconstruct(spark.createDataFrame(log, LOG)).orderBy("message").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "hello!"), ("assistant", "good")]


PARTS = st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "[", "|>", "s>", "/s>", "a", "é", "𝄞", " ", "<|im_", "im_end|>"])


@given(st.lists(st.lists(PARTS, max_size=6).map("".join), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_escapes_are_undone_and_leave_no_mark(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.lists(PARTS, max_size=3).map("".join), st.lists(PARTS, max_size=6).map("".join)), min_size=1, max_size=12))
@settings(max_examples=15, deadline=None)
def test_conversations_come_back(spark, said):
    said = [(role or "assistant", text) for role, text in said]
    rows = spark.createDataFrame([(5, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, message long, role string, text string")
    got = chat.read_back(chat.render(rows)).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == said
    assert got["loss_text"] == "".join(t for r, t in said if r == "assistant")


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, "user", None), (1, 3, None, "no role"), (1, 4, "assistant", "same"), (1, 4, "assistant", "same"),
        (2, 0, "assistant", "x" * 300_000 + "</s>"), (3, 0, "user", ""),
    ]
    log = chat.log_of(spark.createDataFrame(rows, TURNS).withColumn("step", F.lit(1)))
    assert log.where("conv_id = 2 AND event = 'delta'").count() > 500
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(log))).collect()}
    told = lambda c: [(t["role"], t["text"]) for t in got[c]["turns"]]
    assert told(None) == [("user", "no id")] and told(3) == [("user", "")] and got[3]["loss_text"] == ""
    assert told(1) == [("user", ""), ("", "no role"), ("assistant", "same"), ("assistant", "same")] and got[1]["loss_text"] == "samesame"
    assert told(2) == [("assistant", rows[5][3])] and "</s>" not in got[2]["formatted"]
    assert chat.render(chat.reconstruct(log.limit(0))).count() == 0


def test_query_has_drafts_and_no_python(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    kinds = {r["event"] for r in chat.log_of(turns).select("event").distinct().collect()}
    assert kinds == set(RANK)
    df = queries.chat_formatting(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "RDD" not in plan and plan.count("Exchange") == 1
    assert df.count() == turns.select("conv_id").distinct().count() + 1
    fixture = df.where("conv_id = -7").first()
    assert fixture["n_turns"] == 2 and fixture["loss_chars"] == len("</s>[INST] ok [/INST]")


