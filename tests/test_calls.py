"""Calls to a fake service that counts them: kept answers, a killed run, a fatal answer, rates."""

import os
import time

import pytest

from corpusloom.sources import calls, enrich


def service(log, fatal=None, killed_at=None, wait=0.0):
    """Appends a line a call; answers with the text's words."""

    def rule(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        time.sleep(wait)
        if killed_at and text == killed_at:
            os._exit(9)
        if text == fatal:
            raise RuntimeError("429 insufficient_quota")
        if text.startswith("bad"):
            raise ValueError("no")
        return text.split()

    return rule


def lines(log):
    return open(log).read().splitlines() if os.path.exists(log) else []


def texts(spark, n):
    return spark.createDataFrame([(f"text {i % n}",) for i in range(2 * n)] + [(None,)], "text string")


def test_every_distinct_text_is_called_for_once_ever(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "kept")
    got = calls.answers(texts(spark, 30), service(log), folder).collect()
    assert len(got) == 31 and {r.outcome for r in got} == {"ok"}
    assert sorted(lines(log)) == sorted(["", *(f"text {i}" for i in range(30))])
    again = calls.answers(texts(spark, 35), service(log), folder).collect()
    assert len(lines(log)) == 31 + 5 and sorted(again)[:1] and len(again) == 36
    calls.answers(texts(spark, 3), service(log), folder, salt="another prompt").collect()
    assert len(lines(log)) == 36 + 4  # another prompt is another question


def test_a_killed_run_repeats_no_answered_call(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "kept")
    one = calls.Limits(concurrent=1, held=0.0)
    with pytest.raises(Exception):
        calls.answers(texts(spark, 40), service(log, killed_at="text 17"), folder, limits=one, parallelism=1).collect()
    before = lines(log)
    assert before.count("text 17") >= 1
    got = calls.answers(texts(spark, 40), service(log), folder, limits=one, parallelism=1).collect()
    after = lines(log)
    assert len(got) == 41 and all(r.outcome == "ok" for r in got)
    assert {t for t in set(after) if after.count(t) > 1} <= {"text 17"}  # the one that never answered


def test_a_fatal_answer_stops_all_calls(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "kept")
    limits = calls.Limits(concurrent=1, held=0.0)
    rows = spark.createDataFrame([(f"text {i}",) for i in range(200)] + [("stop here",)], "text string")
    got = calls.answers(rows, service(log, fatal="stop here", wait=0.02), folder, limits=limits, parallelism=4).collect()
    told = lines(log)
    outcomes = {r.outcome for r in got}
    assert outcomes == {"ok", "fatal", "stopped"} and len(got) == 201
    # Each of four workers may have had one call under way.
    assert len(told) - told.index("stop here") - 1 <= 4
    assert "insufficient_quota" in calls.stopped(folder)
    assert {r.outcome for r in calls.answers(rows, service(log), folder).collect()} == {"ok", "stopped"} and len(lines(log)) == len(told)
    calls.resume(folder)
    assert {r.outcome for r in calls.answers(rows, service(log), folder).collect()} == {"ok"}
    assert sorted(lines(log)) == sorted([*told, *({r[0] for r in rows.collect()} - set(told)), "stop here"])


def test_errors_are_rows_and_are_tried_anew(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "kept")
    rows = spark.createDataFrame([("bad one",), ("good",)], "text string")
    for n in (1, 2):
        got = {r.outcome: r for r in calls.answers(rows, service(log), folder).collect()}
        assert got["error"].error == "ValueError: no" and got["error"].answer is None and got["ok"].answer == '["good"]'
        assert lines(log).count("bad one") == n and lines(log).count("good") == 1


def test_calls_keep_to_the_rate(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "kept")
    began = time.monotonic()
    calls.answers(texts(spark, 9), service(log), folder, limits=calls.Limits(concurrent=8, per_second=10.0), parallelism=1).collect()
    assert time.monotonic() - began >= 0.9


def test_names_without_a_cap(spark):
    rows = spark.createDataFrame([(1, "Alpha Beta Gamma Delta Epsilon Zeta Thetas Alpha"), (2, None)], "id int, t string")
    got = {r.id: r for r in enrich.enrich(rows, "names", "id", "t").collect()}
    assert got[1]["items"] == ["Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Thetas"] and got[2]["items"] == [] and got[2].ok
