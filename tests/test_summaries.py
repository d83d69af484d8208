"""Merge calls: the ladder by plain Python, the order of parts, and what a failed call gives."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import summaries as S
from corpusloom.sources import enrich as E
from corpusloom.sources.calls import Limits

ONCE = Limits(waits=())


def clip(text, n):
    flat = " ".join(text.split())
    return flat[: n - 3] + "..." if len(flat) > n else flat


def sample(v, n=10):
    v = sorted(set(v))
    return v if len(v) <= n else v[:5] + v[-5:]


def expected(parts, head, budget):
    for step in S.LADDER:
        rows = [{"batch": b, "total": len(parts), "chapters": sample(c), "fact_count": n, "markdown": clip(m or "", step)} for b, c, n, m in sorted(parts, key=lambda p: p[0])]
        text = head + json.dumps(rows, ensure_ascii=False, separators=(",", ":"))
        if len(text) <= budget:
            break
    return step, text


QUESTIONS = {
    1: [(2, [3, 1, 1], 2, "two  words\nand more"), (1, list(range(30)), 30, "x" * 500), (10, [], 0, None)],
    2: [(1, [1], 1, "short")],
    3: [(i, [i], 1, f"{i} " + "ä" * 4000) for i in range(1, 13)],
    4: [(i, [i], 1, "word " * 90) for i in range(1, 4)],
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(q, b, len(parts), c, n, m) for q, parts in QUESTIONS.items() for b, c, n, m in parts]
    return spark.createDataFrame(rows, "query_id int, batch int, total int, chapters array<int>, fact_count int, markdown string").repartition(3)


@pytest.mark.parametrize("budget", [300, 1000, 2500, 20_000, 10**6])
def test_ladder(results, budget):
    head = F.concat(F.lit("Q"), "query_id", F.lit(":\n"))
    got = {r.query_id: (r.step, r.input) for r in S.merge_inputs(results, ["query_id"], budget, head).collect()}
    assert got == {q: expected(parts, f"Q{q}:\n", budget) for q, parts in QUESTIONS.items()}
    chars = {r.query_id: r.chars for r in S.steps(results, ["query_id"], budget, F.length(head)).collect()}
    assert chars == {q: len(text) for q, (_, text) in got.items()}


def answering(text):
    if "Q1" in text:
        raise ValueError("no available upstream")
    if "Q2" in text:
        return "  "
    if "Q3" in text:
        raise ValueError("bad schema")
    return "# All of it"


def test_a_failed_merge_is_covered_or_told(results, monkeypatch):
    monkeypatch.setitem(E.SUMMARISERS, "service", answering)
    head = F.concat(F.lit("Q"), "query_id", F.lit(":\n"))
    got = {r.query_id: r for r in S.merged(results, ["query_id"], "service", 2500, head, limits=ONCE).collect()}
    assert {q: r.how for q, r in got.items()} == {1: "model_unavailable", 2: "empty_text", 3: "failed", 4: "merged"}
    assert got[1].answer == "### Part 1/3\n" + "x" * 500 + "\n\n### Part 2/3\ntwo  words\nand more\n\n### Part 10/3\n"
    assert (got[2].answer, got[3].answer, got[4].answer) == ("### Part 1/1\nshort", None, "# All of it") and "bad schema" in got[3].error


def test_no_results(results, monkeypatch):
    assert S.merged(results.limit(0), ["query_id"], "excerpt", 900, F.lit("")).collect() == []
