"""Windows of conversations: what they hold, read back, and their budgets, against a plain version."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import chat

FIELDS = "conv_id long, turn long, role string, text string"


def _order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def _conversations(seed=11):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(["ab ", "é", "\n", "\\", "<", "[", "</s>", "<|im_end|>\n", "<\\|im_end|>", "[/INST]", "<<SYS>>", "<\\\\s>", "日"]) for _ in range(n))
    rows = []
    for c in range(12):
        if c % 3:
            rows.append((c, 0, "system", say(rng.randrange(60))))
        rows += [(c, t, ("user", "assistant")[t % 2], say(rng.randrange(120))) for t in range(1, rng.choice([2, 6, 40]))]
    rows += [(20, t, ("user", "assistant")[t % 2], say(8)) for t in range(1, 900)] + [(20, 0, "system", "be <s>")]  # three blocks of 300
    rows += [(21, 5, None, None), (21, None, "ro\\le\nx<s>", "t"), (21, 9, "assistant", ""), (None, 1, "assistant", "no id"), (22, 0, "assistant", "w" * 9000), (22, 1, "user", "x"), (22, 2, "assistant", "y")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _conversations()


@pytest.fixture(scope="module")
def made(spark, rows):
    df = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in ("block", "kind", "o", "piece", "sys", "tokens", "loss")})
    return chat.windows(df.repartition(5), budget=200, history=60, block=300).persist()


def test_round_trip(made, rows):
    got = {}
    for r in sorted(chat.read_back(made).collect(), key=lambda r: (r.conv_id or -1, r.block, r.window)):
        turns, learnt = got.setdefault(r.conv_id, ([], []))
        turns += [(t.role, t.text) for t in r.turns]
        learnt.append(r.learnt)
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in _order([r for r in rows if r[0] == conv])]
        assert got[conv][0] == mine
        assert "".join(got[conv][1]) == "".join(t for role, t in mine if role == "assistant")


def test_budget_history_and_system(made, rows):
    cost = lambda t: -(-len(t) // 4) + 4
    for r in made.collect():
        parts = r.text.split("<|im_end|>\n")[:-1]
        assert len(parts) == r.repeated + r.own
        system = next((t for c, _, role, t in _order([x for x in rows if x[0] == r.conv_id]) if role == "system"), None)
        mine = [(x[2] or "", x[3] or "") for x in _order([x for x in rows if x[0] == r.conv_id])]
        assert r.tokens <= 200 or r.own == 1
        if r.repeated and system is not None:
            assert parts[0].startswith("<|im_start|>system\n")
        if (r.block, r.window) > (0, 0) and r.conv_id == 20:
            assert r.repeated >= 2 and parts[0] == "<|im_start|>system\nbe <\\s>"
        for s in r.loss:  # nothing repeated lies under the mask
            assert r.text[: s.start].count("<|im_end|>\n") >= r.repeated
        assert sum(cost(t) for _, t in mine) >= r.own


def test_repeated_turns_are_those_before(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " + "x" * 40) for t in range(40)]
    out = sorted(chat.windows(spark.createDataFrame(rows, FIELDS), budget=120, history=40, block=16).collect(), key=lambda r: (r.block, r.window))
    at = 0
    for r in out:
        numbers = [int(p.split("turn ")[1].split(" ")[0]) for p in r.text.split("<|im_end|>\n")[:-1]]
        assert numbers == list(range(at - r.repeated, at + r.own)) and r.repeated == min(at, 2)  # 16 tokens a turn
        at += r.own
    assert at == 40


def test_empty(spark):
    none = spark.createDataFrame([], FIELDS)
    assert chat.windows(none).count() == 0 and chat.read_back(chat.windows(none)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "/", "s>", "INST]", "|im_end|>", "<SYS>>", "a"]), max_size=8).map("".join), min_size=1, max_size=40))
def test_escapes_reverse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"), chat._role_in(chat._role_out(F.col("t"))).alias("r")).collect():
        assert r.u == r.t and r.r == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_no_python_in_the_plan(spark):
    plan = chat.op12_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
