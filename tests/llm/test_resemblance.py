"""Near copies at a Jaccard similarity of 0.8 against brute force."""

import random

import xxhash

import corpus_pipeline
from corpusloom.llm import resemblance
from tests.llm.test_operators import make


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_pairs(texts):
    sets = [shingles(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]


def kept(texts):
    root = list(range(len(texts)))
    pairs = near_pairs(texts)
    while True:
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return [i for i in range(len(texts)) if root[i] == i]


def copies(seed=3):
    """Texts of 8 to 300 words, copies of them with up to a tenth of their words changed, chains of changes, odd ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([8, 30, 60, 150, 300]))) for _ in range(60)]
    for _ in range(140):
        words = r.choice(texts).split()
        for _ in range(r.randint(0, 1 + len(words) // 25)):
            words[r.choice([0, -1, r.randrange(len(words))])] = r.choice(vocabulary)
        texts.append(" ".join(words))
    return [*texts, "", None, " \n", "one two", "One  TWO", "three"]


def test_stage_keeps_one_of_each_group(spark, monkeypatch):
    texts = copies()
    want = kept(texts)
    docs = make(spark, texts).repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    monkeypatch.setattr(resemblance, "BLOCK_POINTS", 2)  # clusters are dealt as pairs of blocks
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_forest_connects_similar_sets():
    texts = [t for t in copies(4) if t and t.strip()]
    root = list(range(len(texts)))
    for a, b in resemblance.forest([resemblance.shingle_set(t) for t in texts]) * len(texts):
        root[a] = root[b] = min(root[a], root[b])
    assert [i for i in range(len(texts)) if root[i] == i] == kept(texts)


def test_large_clusters_of_far_and_near_copies(spark):
    """One base with random changes: most copies are near the base, few near each other."""
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(190)]
    texts = [" ".join(base)]
    for _ in range(500):
        words = list(base)
        for _ in range(r.randrange(9)):
            words[r.randrange(190)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, make(spark, texts), "").collect()) == kept(texts)


def test_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(50))
    near, other = base + " end", " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(5, base), (5, other), (7, near), (8, other + " end"), (None, base), (None, near), (None, "alone"), (9, "again"), (9, "again")], "doc_id long, text string")
    rows = sorted((str(r[0]), r[1]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert rows == sorted([("5", base), ("5", other), ("None", "alone"), ("9", "again")])


def test_simhash_links_by_itself(spark, monkeypatch):
    """Without bands the stage gives what pairs of two or fewer bits connect, verified: also sets with equal SimHashes."""
    r = random.Random(6)
    texts = copies(6)
    for _ in range(30):
        words = [f"v{r.randrange(10**5)}" for _ in range(500)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(["begin", *words[1:]])]

    def bits(text):
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles(text)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def roots(pairs):
        root, before = list(range(len(texts))), None
        while root != before:
            before = list(root)
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    fps = [bits(t) for t in texts]
    met = roots([(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    same = roots([(i, j) for i, j in near_pairs(texts) if met[i] == met[j]])
    want = [i for i in range(len(texts)) if same[i] == i]
    assert len(kept(texts)) < len(want) < len(texts) - 60
    monkeypatch.setattr(resemblance, "band_links", lambda points: points.select("fp", "fp").toDF("a", "b").limit(0))
    assert sorted(row["doc_id"] for row in corpus_pipeline.near_duplicates(spark, make(spark, texts).repartition(3), "").collect()) == want
