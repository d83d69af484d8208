"""Known answers and rows that the driver's tables don't have."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import questions as Q
from corpusloom.operators import containment
from corpusloom.operators import coverage as V
from corpusloom.operators import json_views as J
from corpusloom.operators import packing as P
from corpusloom.operators import recall as R
from corpusloom.operators import subjects as S
from corpusloom.operators import upsert as U
from corpusloom.sources import enrich as E
from corpusloom.sources import envelopes as N
from corpusloom.streaming import tasks as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_batches(spark):
    got = V.batches(spark.createDataFrame([(1, 25)], "start_chapter int, end_chapter int")).collect()
    assert [(r["batch_start"], r["batch_end"]) for r in got] == [(1, 10), (11, 20), (21, 25)]


def test_coverage_of_empty_failed_and_outdated_chapters(spark):
    chapters = spark.createDataFrame([("b", i, f"h{i}") for i in range(1, 6)], "book_id string, chapter_index int, content_hash string")
    status = spark.createDataFrame([("b", 1, "completed", "h1", 2), ("b", 2, "completed", "h2", 0), ("b", 3, "failed", "h3", 0), ("b", 5, "completed", "old", 0)], "book_id string, chapter_index int, status string, source_hash string, facts_count int")
    row = V.fact_coverage(chapters, status).first()
    assert (row["completed"], row["empty"], row["outdated"], row["failed"], row["missing"]) == (3, 2, 1, 1, 1)
    assert (row["failed_chapters"], row["empty_chapters"]) == ("3", "2,5")
    assert V.route_coverage(chapters, status).first()["completed"] == 2
    plan = {m: sorted(r["chapter_index"] for r in V.work_list(chapters, status, m).collect()) for m in ("all", "retry_failed", "retry_empty", "missing")}
    assert plan == {"all": [3, 4, 5], "retry_failed": [3], "retry_empty": [2, 5], "missing": [4]}
    assert V.work_list(chapters, status, "all", force=True).count() == 5


def test_scalars(spark):
    assert one(spark, C.key(F.lit("  My Group!! #1 __"))) == "my-group-1"
    assert one(spark, C.key(F.lit("！！"))) == "base" and one(spark, C.key(F.lit(None).cast("string"))) == "base"
    assert [one(spark, C.clamp01(F.lit(x))) for x in (float("nan"), float("inf"), -1.0, 0.4, 7.0, None)] == [0, 0, 0, 0.4, 1, 0]
    assert one(spark, C.redact(F.lit("use app-abc12345 and Bearer xyz.123"))) == "use app-*** and Bearer ***"
    assert one(spark, C.unique_compact(F.array(F.lit(" 剑 "), F.lit("剑"), F.lit("　"), F.lit("b")), 5)) == ["剑", "b"]
    assert one(spark, C.chapter_sample(F.sequence(F.lit(1), F.lit(40)), 4)) == [1, 2, 39, 40]
    assert one(spark, C.duration(F.lit(3_725_000))) == "1h 2m 5s"


FACT = "fact_id string, fact string, entity string, importance double, confidence double, chapter_index int, fields array<string>, evidence string"
PLAIN = Q.Vocabulary(leading="-", trailing="-", stop="-")


def fact_table(spark, rows):
    return spark.createDataFrame(rows, FACT).withColumn("text", F.lower(F.concat_ws(" ", "fact", "fields", "evidence")))


def test_recall_puts_targets_with_terms_first(spark):
    facts = [(f"f{i}", f"weak fact number{i}", "other", 0.9, 0.9, i, ["other"], "") for i in range(180)] + [(f"t{i}", f"the silverblade {i}", "silverblade", 0.1, 0.1, 200 + i, ["silverblade"], "") for i in range(5)]
    table = fact_table(spark, facts)
    terms = spark.createDataFrame([(1, "silverblade"), (1, "weak")], "query_id int, term string")
    ranked = R.ranked(R.score(table, terms), 1000).orderBy("place").collect()
    assert len(ranked) == 185 and {r["fact_id"] for r in ranked[:5]} == {f"t{i}" for i in range(5)}
    assert R.ranked(R.score(table, terms), 160).count() == 160


def test_recall_takes_all_facts_of_a_target_and_expands_else(spark):
    facts = [(f"t{i}", "it shone", "moonlamp", 0.1, 0.1, i + 1, ["moonlamp"], "") for i in range(3)] + [("s", "a glassworker came", "glassworker", 0.5, 0.5, 7, ["glassworker", "guildhall"], "said “oldname” once")]
    facts += [("g", "the guildhall burned", "fire", 0.2, 0.2, 9, ["fire"], ""), ("q", "oldname again", "x", 0.2, 0.2, 9, ["x"], ""), ("n", "nothing of it", "y", 0.9, 0.9, 2, ["y"], "")]
    questions = spark.createDataFrame([(1, ["moonlamp", "guildhall"], "moonlamp"), (2, ["glassworker"], None), (3, ["unheard"], "unheard")], "query_id int, terms array<string>, target string")
    got = {}
    for r in R.recall(fact_table(spark, facts), questions, PLAIN).entries.collect():
        got.setdefault(r["query_id"], {})[r["fact_id"]] = r["target"]
    assert got == {1: {"t0": True, "t1": True, "t2": True, "s": True}, 2: {"s": False, "g": False, "q": False}}


def test_terms_of_two_letters_and_with_spaces(spark):
    facts = fact_table(spark, [("a", "in the big house", "x", 0.0, 0.0, 1, ["x"], ""), ("b", "三尺之剑名曰初一", "初一", 0.0, 0.0, 2, ["初一"], ""), ("c", "bigger houses", "y", 0.0, 0.0, 3, ["y"], "")])
    terms = spark.createDataFrame([(1, "Big House"), (2, "初一"), (3, "se"), (4, "x")], "query_id int, term string")
    assert {(r["query_id"], r["fact_id"]) for r in R.matches(facts, terms).collect()} == {(1, "a"), (2, "b"), (3, "a"), (3, "c")}


def test_containment_by_automaton_and_by_runs(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab剑 c") for _ in range(r.randint(0, 60))) for _ in range(80)] + ["", None]
    patterns = ["".join(r.choice("ab剑 c") for _ in range(r.choice([1, 2, 3, 5, 9, 17]))) for _ in range(60)] + ["", None]
    left, right = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {(i, p) for i, t in enumerate(texts) for p in patterns if p and p in (t or "")}
    for most in (10**6, 0):
        found = [tuple(x) for x in containment.contained(left, right, most).collect()]
        assert len(found) == len(want) and set(found) == want
        assert containment.contained(left.limit(0), right, most).count() == containment.contained(left, right.limit(0), most).count() == 0


def test_recall_matches_inside_words(spark):
    facts = spark.createDataFrame([("a", "他拔出了飞剑胚而去"), ("b", "nothing here"), ("c", "abcXYZdef")], "fact_id string, text string")
    terms = spark.createDataFrame([(1, "飞剑胚"), (2, "xyz"), (3, "def")], "query_id int, term string")
    assert {(r["query_id"], r["fact_id"]) for r in R.matches(facts, terms).collect()} == {(1, "a"), (2, "c"), (3, "c")}


def test_coverage_pick_keeps_all_when_few(spark):
    rows = [(1, f"f{i}", i % 7 + 1, 100.0 - i, 1, 0.5) for i in range(30)]
    entries = spark.createDataFrame(rows, "query_id int, fact_id string, chapter_index int, score double, matched int, importance double")
    assert R.coverage_pick(entries, 40).count() == 30 and R.coverage_pick(entries, 30, F.lit(7) + F.col("query_id")).count() == 8
    picked = R.coverage_pick(entries, 10).collect()
    assert len(picked) == 10 and {f"f{i}" for i in range(6)} <= {r["fact_id"] for r in picked}


def test_subject_fold_keeps_quirks(spark):
    rows = [("b", "k", 1, "verified", 9, "K", "beast", "", "p", "", [], 0.2, ["x"]), ("b", "k", 2, "verified", 12, "K2", "spirit", "", "p", "seen", ["e1"], 0.9, ["y"]), ("b", "k", 3, "candidate", 4, "K3", "tree", "seed", "q", "later", ["e2"], 0.1, ["x", " z "])]
    row = S.fold(spark.createDataFrame(rows, "book_id string, subject_key string, pos int, status string, chapter int, canonical_name string, creature_type string, original_form string, prompt_hash string, basis string, evidence array<string>, confidence double, aliases array<string>")).first()
    assert (row["status"], row["qualification_chapter"], row["basis"], row["evidence"], row["confidence"], row["aliases"]) == ("candidate", 4, "seen", ["e1"], 0.9, ["x", "k", "y", "z"])
    assert (row["canonical_name"], row["creature_type"], row["original_form"], row["prompt_hash"]) == ("K3", "tree", "seed", "q")


def test_chunks(spark):
    # A prompt of n facts: overhead 7, the digits of n, two brackets, the facts and n - 1 commas.
    rows = [(1, p, s, 7) for p, s in enumerate([[40, 20], [49, 20], [20, 20], [500, 90], [90, 30], [500, 400], [10, 10]], 1)]
    got = P.chunk_numbers(spark.createDataFrame(rows, "query_id int, place int, sizes array<int>, overhead int"), budget=100).orderBy("place").collect()
    assert [(r["chunk"], r["rung"]) for r in got] == [(1, 0), (1, 0), (2, 0), (3, 1), (4, 0), (None, None), (5, 0)]
    # One character more, and the second fact doesn't stand beside the first.
    rows[1] = (1, 2, [50, 20], 7)
    got = P.chunk_numbers(spark.createDataFrame(rows, "query_id int, place int, sizes array<int>, overhead int"), budget=100).orderBy("place").collect()
    assert [r["chunk"] for r in got][:3] == [1, 2, 2]


def test_a_second_digit_drops_a_fact(spark):
    """Ten facts of one character: nine commas, and the count has two digits, which is one character too many."""
    facts = spark.createDataFrame([(1, p, [1], 0) for p in range(1, 11)], "query_id int, place int, sizes array<int>, overhead int")
    chunks = lambda budget: [r["chunk"] for r in P.chunk_numbers(facts, budget).orderBy("place").collect()]
    assert chunks(2 + 10 + 9 + 2) == [1] * 10 and chunks(2 + 10 + 9 + 1) == [1] * 9 + [2]
    # Ten chunks: the numbers of chunk and total (1 to 10 of 10) come in after packing; only chunk 10's has two digits.
    packed = spark.createDataFrame([(1, 2 * c + k, c + 1, 5, 10) for c in range(10) for k in range(2)], "query_id int, place int, chunk int, size int, overhead int")
    fits = 10 + 1 + 2 + 2 * 5 + 1 + 1 + 2
    kept = {(r["chunk"], r["place"]) for r in P.trimmed(packed, fits).where("kept").collect()}
    assert {c for c, _ in kept} == set(range(1, 11)) and len(kept) == 19 and (10, 18) in kept and (10, 19) not in kept


def test_upsert_last_wins_and_keeps(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "c", 99, 1), (2, "d", 99, 2), (3, "e", 30, 1)], "id int, v string, created int, pos int")
    assert sorted(map(tuple, U.latest(old, new, ["id"], keep=("created",)).collect())) == [(1, "a", 10), (2, "d", 20), (3, "e", 30)]


def test_chapter_payloads(spark):
    rows = [(1, '{"chapters":[{"chapter_index":3,"content":"x"},{"sort_id":"4th","text":"y"},{"content":"","status":"empty"}]}', 1), (2, 'see ```json\n[{"chapterContent":"z","chapterIndex":"no"}]\n``` there', 7), (3, "bare text", 5), (4, '{"index":9,"text":"w"}', 1), (5, '{"output":"{\\"records\\":[{\\"index\\":2,\\"chapter_content\\":\\"v\\"}]}"}', 1)]
    got = {(r["id"], r["chapter_index"], r["content"], r["fetch_status"]) for r in N.chapters(spark.createDataFrame(rows, "id int, p string, s int"), "id", "p", "s").collect()}
    assert got == {(1, 3, "x", "ok"), (1, 4, "y", "ok"), (1, 3, "", "empty"), (2, 7, "z", "ok"), (3, 5, "bare text", "ok"), (4, 1, "w", "ok"), (5, 2, "v", "ok")}


def test_numbers_by_stretches_equal_one_window(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), i) for i in r.sample(range(-50, 900), 300)]
    got = {(x["g"], x["i"]): x["n"] for x in V.numbered(spark.createDataFrame(rows, "g string, i long"), "g", "i", "n", stretch=64).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {(g, i): n for n, i in enumerate(sorted(i for h, i in rows if h == g), 1)}
    assert got == want


def test_summariser_failure_is_a_part(spark):
    def rule(text):
        raise E.TransportError("timed out")

    E.SUMMARISERS["broken"] = rule
    got = E.summarise(spark.createDataFrame([(1, "a")], "part int, body string"), "broken", ["part"], "body", limits=E.Limits(waits=(0.0, 0.0))).first()
    assert not got["ok"] and got["error"] == "timed out"


def test_extractor_failure_is_a_row(spark):
    def rule(text):
        if text == "bad":
            raise ValueError("no")
        return [text]

    E.EXTRACTORS["test"] = rule
    got = {r["id"]: r for r in E.enrich(spark.createDataFrame([(1, "bad"), (2, "fine"), (3, None)], "id int, t string"), "test", "id", "t").collect()}
    assert not got[1]["ok"] and "ValueError" in got[1]["error"] and got[2]["items"] == ["fine"] and got[3]["ok"]


def test_elapsed_without_pauses(spark):
    log = [(1, 1, 0.0, "created", 5), (1, 2, 10.0, "progress", 5), (1, 3, 12.0, "paused", 5), (1, 4, 112.0, "resumed", 5), (1, 5, 118.0, "progress", 5)]
    got = [(x["elapsed"], x["remaining"]) for x in T.durations(spark.createDataFrame(log, "task_id int, seq int, at double, event string, total int")).orderBy("seq").collect()]
    assert got[1] == (10.0, 40.0) and got[3][0] == 12.0 and got[4] == (18.0, 324.0)


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "once the golden hall of winds opened"), (2, "a golden hall"), (3, "“Ash”, he said"), (4, "剑灵初一醒来"), (5, "washed")], "doc_id int, text string")
    names = spark.createDataFrame([(7, "golden hall of winds"), (8, "golden hall elsewhere"), (9, "Ash"), (10, "初一"), (11, "ash"), (11, "hall of")], "subject_id int, name string")
    assert sorted(tuple(r) for r in S.mentions(texts, names).collect()) == [(1, 7), (1, 11), (3, 9), (4, 10), (5, 11)]


def test_jsons_as_tables(spark):
    v = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":1}}}},"n":null,"t":[1,"x"],"r":[{"k":"v","z":""},2]}')], "id int, s string").select("id", F.parse_json("s").alias("v"))
    assert sorted((r["path"], r["value"]) for r in J.flattened(v, ["id"], "v").collect()) == [("a / b / c / d / e", "1"), ("r", "k：v\n2"), ("t", "1, x")]


def test_question_rules_on_cjk_text(spark):
    v = Q.Vocabulary(leading="请|帮我|整理", trailing="清单|内容", stop="章节", dictionary=("古镜", "长桥"), asks=(("清单", "list"),), many="所有|清单", subjects="古镜", extra=(("镜", "mirror"), ("桥", "bridge")))
    q = F.lit("请整理所有古镜清单：《长桥夜雨》，章节")
    assert one(spark, Q.terms(q, v)) == ["长桥夜雨", "所有古镜", "古镜", "长桥"]
    assert one(spark, Q.collection_reason(q, v)) == "list" and one(spark, Q.collection_reason(F.lit("古镜在哪"), v)) == ""
    assert one(spark, Q.intent(F.lit(""), F.lit("x"))) == "target" and one(spark, Q.intent(F.lit(""), F.lit(None).cast("string"))) == "query"
    assert one(spark, Q.intent_terms(q, v)) == ["mirror", "bridge"]
    assert [one(spark, c) for c in Q.possessive(F.lit("阿木的师父的灯"))] == ["阿木的师父", "灯"]
    assert one(spark, Q.aliases(F.lit("阿木（又名木头）、老木"))) == ["阿木", "木头", "老木"]
    assert one(spark, Q.target(F.lit("说说「长桥」"), None, ("「([^」]+)」",))) == "长桥"
