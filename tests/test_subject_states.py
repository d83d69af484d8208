"""Subjects folded piece by piece: merging states of consecutive upserts is folding all of them."""

import random

import pytest

from corpusloom.operators import subjects as S

SCHEMA = "book_id string, subject_key string, pos long, status string, chapter int, canonical_name string, creature_type string, original_form string, prompt_hash string, basis string, evidence array<string>, confidence double, aliases array<string>"


def upserts(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        key = rng.choice("abcdef")
        rows.append(("b", key, pos, rng.choice(["verified", "candidate", "candidate"]), rng.randrange(1, 50), rng.choice([key, "N" + key]), rng.choice("xy"), None, "p", rng.choice(["", "", "seen", "told"]), rng.choice([[], ["e%d" % pos]]), rng.random(), [rng.choice("uvwxyz") + str(rng.randrange(20)) for _ in range(rng.randrange(4))]))
    return rows


def plain(df):
    return sorted(map(str, df.collect()))


def by_hand(rows):
    """The rule, one upsert after another."""
    out = {}
    for r in rows:
        _, key, _, status, chapter, name, _, _, _, basis, evidence, confidence, aliases = r
        s = out.setdefault(key, {"status": None, "chapter": None, "verified": False, "basis": "", "evidence": [], "confidence": 0.0, "aliases": []})
        if status == "verified":
            s["chapter"], s["verified"] = chapter, True
        else:
            s["chapter"] = chapter if s["chapter"] is None else min(s["chapter"], chapter)
        s["status"], s["name"] = status, name
        s["basis"], s["evidence"], s["confidence"] = s["basis"] or basis, s["evidence"] or evidence, max(s["confidence"], confidence)
        for alias in list(dict.fromkeys(aliases)) + ([key] if key != name else []):
            if alias not in s["aliases"] and len(s["aliases"]) < S.MOST_ALIASES:
                s["aliases"].append(alias)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merging_states_is_folding_all(spark, seed):
    rows = upserts(seed, 120)
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, 120), 2))
    whole = spark.createDataFrame(rows, SCHEMA)
    a, b, c = (spark.createDataFrame(rows[i:j], SCHEMA) for i, j in zip([0, *cuts], [*cuts, 120], strict=True))
    states = [S.fold_state(x) for x in (a, b, c)]
    left = S.merged_state(S.merged_state(states[0], states[1]), states[2])
    right = S.merged_state(states[0], S.merged_state(states[1], states[2]))
    assert plain(left) == plain(right) == plain(S.fold_state(whole).select(*left.columns))
    want = by_hand(rows)
    for r in S.of_state(left).collect():
        s = want[r.subject_key]
        assert (r.status, r.canonical_name, r.qualification_chapter, r.basis, r.evidence, r.confidence, r.aliases) == (s["status"], s["name"], s["chapter"], s["basis"], s["evidence"], s["confidence"], s["aliases"])


def test_merging_with_nothing_and_out_of_order(spark):
    rows = upserts(9, 30)
    some, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    state = S.fold_state(some)
    assert plain(S.merged_state(state, S.fold_state(none))) == plain(S.merged_state(S.fold_state(none), state)) == plain(state)
    with pytest.raises(Exception, match="aren't in order"):
        S.merged_state(state, state).collect()
