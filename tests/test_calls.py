"""Paced calls: nothing is asked twice, errors have kinds, runs can be stopped."""

import time

import pytest

from tourweave.sources import calls as C


def client(log):
    def call(body):
        with open(log, "a") as f:
            f.write(f"{body} {time.time()}\n")
        if body.startswith("status"):
            raise C.Status(int(body[6:]))
        if body == "slow":
            time.sleep(3)
        if body == "offline":
            raise ConnectionError("no route")
        if body == "broken":
            raise ValueError("no json")
        return body.upper()

    return call


def asked(log):
    return [line.split()[0] for line in open(log)] if log.exists() else []


def test_kinds_of_errors_and_what_is_asked_again(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    bodies = ["a", "b", "status429", "status500", "slow", "offline", "broken", "a", None]
    requests = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "request_id long, body string")
    assert C.ask(requests, client(log), ledger, interval=0.0, timeout=0.5)
    got = {r["request_id"]: (r["response"], r["error"]) for r in C.answered(requests, ledger).collect()}
    assert got == {0: ("A", None), 1: ("B", None), 2: (None, "busy"), 3: (None, "unreachable"), 4: (None, "silent"), 5: (None, "offline"), 6: (None, "broken"), 7: ("A", None), 8: (None, None)}
    assert sorted(asked(log)) == sorted(set(filter(None, bodies)))
    assert C.ask(requests, client(log), ledger, interval=0.0, timeout=0.5)
    assert sorted(asked(log)[7:]) == ["offline", "slow", "status429", "status500"]  # answers, and what can't pass, are kept
    assert C.answers(spark, ledger).where("attempt = 2").count() == 4


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    log, ledger = tmp_path / "log", str(tmp_path / "ledger")
    requests = spark.createDataFrame([(f"r{i}",) for i in range(7)], "body string")
    looks = iter([False, False, True])
    assert not C.ask(requests, client(log), ledger, interval=0.0, batch=2, cancelled=lambda: next(looks))
    assert len(asked(log)) == 4

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        C.ask(requests, client(log), ledger, interval=0.0, batch=2, cancelled=killed)
    assert C.ask(requests, client(log), ledger, interval=0.0, batch=2) and sorted(asked(log)) == [f"r{i}" for i in range(7)]
    assert C.ask(requests, client(log), ledger, interval=0.0) and len(asked(log)) == 7


def test_the_pace_is_kept(spark, tmp_path):
    log = tmp_path / "log"
    C.ask(spark.createDataFrame([(f"r{i}",) for i in range(4)], "body string").repartition(4), client(log), str(tmp_path / "ledger"), interval=0.3)
    times = sorted(float(line.split()[1]) for line in open(log))
    assert min(b - a for a, b in zip(times, times[1:])) > 0.25
