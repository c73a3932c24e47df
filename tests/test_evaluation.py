"""Isolated evaluation: errors stay with their rows, and what was answered isn't asked again, whatever is killed."""

import os
from collections import Counter

import pyarrow as pa
import pytest

from newsloom.operators import evaluation

RESULT = "n long, tags array<string>"


def _asks(folder):
    return Counter(x for f in os.listdir(folder) for x in open(os.path.join(folder, f)).read().split())


def _asker(folder, bomb=-1):
    def ask(row):
        with open(os.path.join(folder, str(os.getpid())), "a") as f:
            f.write(f"{row['a']} ")
        if row["a"] == bomb:
            os._exit(1)
        if row["a"] % 4 == 0:
            raise KeyError("four")
        if row["a"] % 5 == 0:
            return {"n": 1, "more": 2}
        if row["a"] % 7 == 0:
            return {"n": "seven"}
        return {"n": row["a"] * 2, "tags": ["x", None]} if row["b"] != "none" else {"n": None}

    return ask


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "asks").mkdir()
    return str(tmp_path / "asks"), str(tmp_path / "answers")


def _rows(spark, n=40):
    return spark.createDataFrame([(i % n, "none" if i % n == 1 else f"b{i % n}", i) for i in range(3 * n)], "a long, b string, outcome_id long").repartition(4)


def _check(got, n=40):
    assert len(got) == 3 * n
    for r in got:
        e, v = r.outcome.error, r.outcome.result
        if r.a % 4 == 0:
            assert (e.code, e.message, v) == ("KeyError", "'four'", None)
        elif r.a % 5 == 0 or r.a % 7 == 0:
            assert e.code == "InvalidResult" and v is None
        else:
            assert e is None and (v.n, v.tags) == ((r.a * 2, ["x", None]) if r.a != 1 else (None, None))


def test_errors_stay_with_their_rows_and_answers_are_reused(spark, folders):
    asks, folder = folders
    _check(evaluation.evaluated(_rows(spark), ["a", "b"], _asker(asks), RESULT, folder=folder).collect())
    assert set(_asks(asks).values()) == {1} and len(_asks(asks)) == 40
    _check(evaluation.evaluated(_rows(spark), ["a", "b"], _asker(asks), RESULT, folder=folder).collect())
    bad = {str(i) for i in range(40) if i % 4 == 0 or i % 5 == 0 or i % 7 == 0}
    assert {k for k, c in _asks(asks).items() if c == 2} == bad  # only failures are asked again
    assert not os.path.exists(f"{folder}/journal")


def test_a_killed_run_goes_on_where_it_stopped(spark, folders):
    asks, folder = folders
    with pytest.raises(Exception):
        evaluation.evaluated(_rows(spark), ["a", "b"], _asker(asks, bomb=33), RESULT, folder=folder, parts=2)
    before = _asks(asks)
    assert before["33"] == 1
    _check(evaluation.evaluated(_rows(spark), ["a", "b"], _asker(asks), RESULT, folder=folder, parts=2).collect())
    fine = [str(i) for i in range(40) if i % 4 and i % 5 and i % 7 and i != 33]
    assert all(_asks(asks)[k] == 1 for k in fine) and _asks(asks)["33"] == 2


def test_a_repeated_task_reads_its_journal(tmp_path):
    journal = evaluation.Journal(f"file:{tmp_path}/j")
    journal.write([{"fingerprint": "f", "outcome": {"result": {"n": 1}, "error": None}}])
    open(f"{tmp_path}/j/half", "w").write('{"fing')  # a file that was being written
    assert evaluation.Journal(f"file://{tmp_path}/j").read() == {"f": {"result": {"n": 1}, "error": None}}


def test_isolated_outcomes():
    kind = pa.struct([("n", pa.int64())])
    assert evaluation.isolated(lambda r: {"n": 3}, {}, kind) == {"result": {"n": 3}, "error": None}
    assert evaluation.isolated(lambda r: None, {}, kind)["error"]["code"] == "InvalidResult"
    assert evaluation.isolated(lambda r: 1 / 0, {}, kind)["error"] == {"code": "ZeroDivisionError", "message": "division by zero"}
    assert evaluation.isolated(lambda r: (_ for _ in ()).throw(OSError()), {}, kind)["error"]["message"] == "OSError"


def test_empty_and_null_inputs(spark, folders):
    asks, folder = folders
    none = spark.createDataFrame([], "a long, b string")
    assert evaluation.evaluated(none, ["a", "b"], _asker(asks), RESULT, folder=folder).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "")], "a long, b string")
    got = evaluation.evaluated(nulls, ["a", "b"], _asker(asks), RESULT, folder=folder)
    assert {r.outcome.error.code for r in got.collect()} == {"TypeError"} and got.select("fingerprint").distinct().count() == 2
