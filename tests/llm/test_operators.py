"""Every operator against brute force, an exact round trip, or held-out accuracy, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, fingerprints, langid, mixing, neighbours, packing, simhash, store, substrings, subwords, token_counts, token_files, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, start string"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", None, "\n\n", "a", "a  b", " a", "a ", "a\tb\r\nc", "it's. <|endoftext|> x<|endoftext|>y", "é́ ́a", "123 45,6", "日本語 テキスト", "😀 ok", "ΑΣ ς", "x\x00y \x01z", "a\x1cb\x1c c", "end.", "end, end. END."]


def make(spark, texts, source=lambda i: "s", first=0):
    rows = [(first + i, t, "en", source(i), None if t is None else len(t), 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed=0, n=60, words=(0, 90)):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(*words))) for _ in range(n)]


@pytest.mark.parametrize("path,kind", [(WORD, "lower"), (BYTE, "bytes")])
def test_units_equal_whole_texts(path, kind):
    encoder = subwords.UnitEncoder(path, kind, most=400)
    for round_ in range(3):  # the memory overflows in between
        texts = [t or "" for t in ODD] + prose(round_, 80) + ["a. " * 3000, "<|ENDOFTEXT|> <|endoftext|>"]
        ids, cut = encoder.encode(texts)
        for i, t in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:60])


@pytest.mark.parametrize("width", [1, 7, 16, 17, 20, 31])
def test_packed_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 4096, 5001):
        ids = rng.integers(0, 1 << width, n).astype(np.uint32)
        assert (token_files.unpack(token_files.pack(ids, width), width, n) == ids).all()


def test_token_files(spark):
    texts = ODD + prose(1)
    docs = make(spark, texts).unionByName(make(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(3)
    path = store.new_dir(spark, "t")
    token_files.write_tokens(docs, path, WORD, "lower", end_id=1, block=128)
    got = sorted((r for r in token_files.read_tokens(spark, path).collect()), key=lambda r: r["start"])
    tokenizer = subwords.encoder(WORD, "lower").tokenizer
    begin = 0
    for row, (doc_id, text) in zip(got, [(None, "no id"), *enumerate(texts)], strict=True):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], bytes(row["ids"])) == (doc_id, begin, len(want), want.tobytes())
        begin += len(want)
    files = sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: r["shard"])
    every = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in got])
    base = 0
    for made in files:  # any span of any file, and none beyond it
        file, n = token_files.TokenFile(made["path"]), made["n_ids"]
        for a, b in ((0, n), (0, 0), (n // 3, n - n // 4), (n - 1, n), (min(5, n), min(140, n))):
            assert (file.ids(a, b) == every[base + a : base + b]).all()
        with pytest.raises(IndexError, match="ids"):
            file.ids(0, n + 1)
        base += n
    empty = store.new_dir(spark, "t")
    token_files.write_tokens(docs.limit(0), empty, WORD, "lower", end_id=1)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 24))
    x = centres[rng.integers(0, 5, 600)] + rng.normal(size=(600, 24))
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(600 + i, [float(v) for v in x[40]]) for i in range(90)]
    rows += [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [None] + [1.0] * 23), (780, [float("inf")] + [1.0] * 23)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0")
    found = neighbours.nearest(vectors, queries, k=20).cache()
    assert neighbours.recall(found, vectors, queries) >= 0.9
    by = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in range(0, 690, 20)}
    for q, rs in by.items():
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r["vec_id"] for r in rs}
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(rs, rs[1:], strict=False))
    assert [r["vec_id"] for r in by[40]] == [600 + i for i in range(20)]  # of 90 equal vectors the smallest ids
    assert neighbours.nearest(vectors.limit(0), queries).count() == 0
    few = vectors.where("vec_id < 5")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 4
    with pytest.raises(ValueError, match="length"):
        neighbours.nearest(few.union(spark.createDataFrame([(9, [1.0])], few.schema)), few)


def test_neighbours_of_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    assert neighbours.recall(neighbours.nearest(vectors, queries, k=20), vectors, queries) >= 0.9


def test_fingerprints(spark):
    texts = ODD + prose(3, 40) + ["same text " * 40, "same text " * 40, "long " * 20000]
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(make(spark, texts).repartition(4), partitions=3).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_text(fingerprints.sketches([t.encode()])[0]), fingerprints.to_text(fingerprints.sketches([edited.encode()])[0]))
        assert tuple(rows[i][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) == want
        for column, other in (("near_edited", edited), ("near_next", after)):
            assert abs(rows[i][column] - brute_likeness(t.encode(), other.encode())) < 1e-12
        for column, other in (("aligned_edited", edited), ("aligned_next", after)):
            assert abs(rows[i][column] - brute_aligned(t.encode(), other.encode())) < 1e-12
    twins = [i for i, t in enumerate(texts) if t and t.startswith("same")]
    assert rows[twins[0]]["fingerprint"] == rows[twins[1]]["fingerprint"] and rows[twins[0]]["near_next"] == 1.0
    assert fingerprints.compare_with_next(make(spark, ["only one"])).count() == 1
    assert fingerprints.compare_with_next(make(spark, [])).count() == 0
    long = [r for r in rows.values() if r["n_chars"] > 300 and not r["near_next"] == 1.0]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2


def brute_anchors(data):
    """Hash to first place of every closed syncmer, by the definition."""
    small = fingerprints._hashes(np.frombuffer(data, np.uint8), fingerprints.S).tolist()
    large = fingerprints._hashes(np.frombuffer(data, np.uint8), fingerprints.K).tolist()
    width, found = fingerprints.K - fingerprints.S + 1, {}
    for i, h in enumerate(large):
        if min(small[i : i + width]) in (small[i], small[i + width - 1]):
            found.setdefault(h, i)
    return found


def brute_likeness(a, b):
    x, y = (sorted(brute_anchors(t))[: fingerprints.KEEP] or ([int.from_bytes(hashlib.sha256(t).digest()[:8], "little")] if t else []) for t in (a, b))
    if not x or not y:
        return float(len(x) == len(y))
    both = sorted({*x, *y})[: min(fingerprints.KEEP, max(len(x), len(y)))]
    return sum(h in x and h in y for h in both) / len(both)


def brute_aligned(a, b):
    x, y = brute_anchors(a), brute_anchors(b)
    if not x or not y:
        return float(len(x) == len(y))
    moved = Counter(y[h] - x[h] for h in x if h in y)
    return max(moved.values(), default=0) / len(x)


def test_fingerprint_and_anchors(spark):
    texts = [*ODD, *prose(31, 6, (40, 90))]
    docs = make(spark, texts)
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()} == {i: fingerprints.to_text(fingerprints.sketches([(t or "").encode()])[0]) for i, t in enumerate(texts)}
    found = {}
    for r in fingerprints.anchors(docs).collect():
        found.setdefault(r["doc_id"], {}).setdefault(r["anchor"] & (2**64 - 1), []).append(r["place"])
    assert {i: {h: min(p) for h, p in a.items()} for i, a in found.items()} == {i: a for i, t in enumerate(texts) if (a := brute_anchors((t or "").encode()))}
    assert fingerprints.anchors(docs.limit(0)).count() == fingerprints.fingerprint(docs.limit(0)).count() == 0


def test_syncmers_by_definition():
    data = np.frombuffer("".join(random.Random(5).choice("abcd ") for _ in range(400)).encode(), np.uint8)
    small = fingerprints._hashes(data, fingerprints.S)
    at, _ = fingerprints.syncmers(data)
    width = fingerprints.K - fingerprints.S + 1
    want = [i for i in range(len(data) - fingerprints.K + 1) if min(small[i : i + width]) in (small[i], small[i + width - 1])]
    assert at.tolist() == want
    shifted, _ = fingerprints.syncmers(np.concatenate([np.frombuffer(b"zz", np.uint8), data]))
    assert set(at + 2) <= set(shifted.tolist())


def brute_repeats(texts, window):
    words = [substrings.split_words(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("vocabulary,hot", [(3, 5000), (40, 5000), (3000, 5000), (3000, 2)])
def test_substrings(spark, vocabulary, hot):
    r = random.Random(vocabulary + hot)
    base = [[f"w{r.randrange(vocabulary)}" for _ in range(r.choice([10, 34, 35, 36, 90, 200]))] for _ in range(12)]
    texts = list(ODD)
    for _ in range(50):
        words = list(r.choice(base))
        if r.random() < 0.5:
            words[r.randrange(len(words))] = f"edit{r.randrange(5)}"
        texts.append(" ".join(words + (r.choice(base)[: r.randrange(60)] if r.random() < 0.5 else [])))
    texts += ["a " * 400, "p q r " * 13, "line of ten words that comes again and again here\n" * 5, *[texts[-1]] * 6]
    rows = substrings.without_repeats(store.staged(make(spark, texts).repartition(3), "t"), hot=hot).collect()
    want = brute_repeats(texts, 35)
    assert len(rows) == len(texts)
    for row in rows:
        assert (row["__n_words"], row["__n_removed"], row["__kept"]) == want[row["doc_id"]]
        assert row["size"] == 1
    assert substrings.without_repeats(make(spark, [])).count() == 0


def test_shards_split_between_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 300)
    texts = prose(9, 40, (60, 120)) * 2
    rows = substrings.without_repeats(store.staged(make(spark, texts), "t")).collect()
    want = brute_repeats(texts, 35)
    assert all((r["__n_removed"], r["__kept"]) == want[r["doc_id"]][1:] for r in rows)


def brute_simhash(text, shingle=3):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    texts = ODD + ["É A-Z Case"] + prose(4, 60)
    for t in prose(4, 60):
        words = t.split()
        texts += [t, " ".join([*words[:-1], "other"]) if words else t]
    rows = simhash.near_groups(make(spark, texts)).collect()
    fps = [brute_simhash(t or "") for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            root[i] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
    assert {(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in rows} == {(i, f, root[i]) for i, f in enumerate(fps)}
    twice = make(spark, ["A b c", "A b c", "other text of it", "X y z", "Y z x", "X y z"]).withColumn("doc_id", F.element_at(F.array(*map(F.lit, [1, 5, 5, 6, 6, 6])), (F.col("doc_id") + 1).cast("int")).cast("long"))
    assert sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(twice).collect()) == [(1, "A b c"), (5, "other text of it"), (6, "X y z"), (6, "Y z x")]
    kept = simhash.deduplicate(make(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root)) and all(r["text"] == texts[r["doc_id"]] for r in kept)
    assert simhash.near_groups(make(spark, [])).count() == 0


def test_simhash_links_of_crowded_cells(spark):
    r = random.Random(6)
    points = {r.getrandbits(64) for _ in range(50)}
    centre = r.getrandbits(64)
    for _ in range(700):
        points.add(centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    points = sorted(points)
    frame = spark.createDataFrame([(p - 2**64 if p >> 63 else p, i) for i, p in enumerate(points)], "fp long, node long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(frame)).collect()}
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 2:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert [found.get(i, i) for i in range(len(points))] == [top(i) for i in range(len(points))]


def test_components(spark):
    r = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for e in links for n in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: m for n, m in root.items() if any(n in e and e[0] != e[1] for e in links)}


def test_token_counts(spark):
    texts = ODD + prose(8) + ["<s> </s> x"]
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(make(spark, texts), PIECE, limit=20).collect()}
    model = token_counts.counter(PIECE).model
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((t or "").encode()), n, n > 20)


def test_long_texts_are_spliced():
    counter = token_counts.TokenCounter(PIECE, chunk=700, overlap=40)
    r = random.Random(9)
    texts = [" ".join(prose(i, 30, (20, 60))) for i in range(4)]
    texts += ["a" * 9000, "  " * 3000, " a  b" * 2000, "日本語テキスト" * 900, "x\ty\n\n" * 900, "▁a " * 900, "😀é " * 900, "".join(r.choice("abc \n") for _ in range(9000))]
    assert [counter.count_all([t])[0] for t in texts] == [len(counter.model.encode(t)) for t in texts]
    assert counter._spliced(texts[0], 40) == len(counter.model.encode(texts[0]))


def reshared(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing what is above the bounds again and again."""
    total = share * sum(sizes)
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in free)
        for i in range(len(sizes)):
            target[i] = left * weights[i] / sum(weights[j] for j in free) if i in free else most * sizes[i]
        above = {i for i in free if target[i] > most * sizes[i]}
        if not above:
            break
        free -= above
        for i in above:
            target[i] = most * sizes[i]
    return target


@pytest.mark.parametrize("block", [100_000, 3])
def test_mixing(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    names = ["b", "a", None, "é", "Z", "hot", ""]
    r = random.Random(10)
    texts = [None if r.random() < 0.05 else " ".join(["w"] * r.choice([0, 1, 5, 5, 5, 30, 70])) for _ in range(400)]
    docs = store.staged(make(spark, texts, lambda i: "hot" if i % 3 == 0 else names[i % 7]), "t")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 400 and {r["size"] for r in rows} == {1}
    size = Counter()
    for row in rows:
        assert row["__size"] == len((row["text"] or "").split())
        size[row["source"]] += row["__size"]
    order = [*sorted((s for s in size if s is not None), key=lambda s: s.encode()), None]
    wanted = dict(zip(order, reshared([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = Counter()
    for row in rows:
        assert row["__source_size"] == size[row["source"]] and abs(row["__target"] - wanted[row["source"]]) < 1e-6
        assert 0 <= row["__copies"] <= 2
        taken[row["source"]] += row["__copies"] * row["__size"]
    for s in order:
        assert abs(taken[s] - wanted[s]) <= 3 * 70
    again = {r["doc_id"]: r["__copies"] for r in mixing.mix(store.staged(docs.repartition(5), "t")).collect()}
    assert again == {r["doc_id"]: r["__copies"] for r in rows}
    mixed = Counter(r["doc_id"] for r in mixing.sample(docs).collect())
    assert mixed == Counter({k: v for k, v in again.items() if v})
    assert mixing.mix(make(spark, [])).count() == 0 and mixing.mix(make(spark, [None, ""])).count() == 2


def test_mixing_is_native(spark):
    plan = mixing.mix(make(spark, prose(11)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_warc(spark):
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "WARC/1.1\r\n\r\n" * 30, "é😀" * 80, "é😀" * 80, *["hot" * 50] * 40, "long" * 300_000]
    pages = spark.createDataFrame([(i, f"http://h/{i} \r\nX: 1" if i % 2 else None, h, "k", i) for i, h in enumerate(html)], "page_id long, url string, html string, payload string, digest int").repartition(3)
    path = store.new_dir(spark, "w")
    archives = warc.write_archives(pages, f"{path}/whole")
    manifest = warc.normalise(archives, f"{path}/members")
    rows = {r["page_id"]: r for r in warc.read_records(spark, f"{path}/members").collect()}
    assert len(rows) == len(html)
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = min(j for j, o in enumerate(html) if (o or "") == (h or ""))
        revisit = len(data) >= 100 and first != i
        row = rows[i]
        assert (row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"]) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
        assert row["payload"] is None if revisit else bytes(row["payload"]) == data
    for m in manifest.collect():
        filesystem, place = store.open_fs(m["path"])
        with filesystem.open_input_stream(place, compression=None) as s:
            data = s.read()
        filesystem, place = store.open_fs(m["index"])
        with filesystem.open_input_stream(place, compression=None) as s:
            lines = [x.split("\t") for x in s.read().decode().splitlines()]
        assert len(lines) == m["records"]
        at = 0
        for offset, length, name, kind in lines:  # members follow one another, each one whole record
            assert int(offset) == at
            engine = zlib.decompressobj(31)
            whole = engine.decompress(data[at : at + int(length)])
            assert engine.eof and not engine.unused_data
            fields, begin = warc.headers_of(whole)
            assert (fields["warc-record-id"], fields["warc-type"]) == (name, kind) and len(whole) == begin + int(fields["content-length"]) + 4
            at += int(length)
        assert at == len(data)
    twice = spark.createDataFrame([(1, "u", "A" * 200), (5, "u", "A" * 200), (5, "u", "B" * 200), (5, "u", "B" * 200), (None, "u", "A" * 200)], "page_id long, url string, html string")
    path = store.new_dir(spark, "w")
    warc.normalise(warc.write_archives(twice, f"{path}/whole"), f"{path}/members")
    found = [(r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])[:1]) for r in warc.read_records(spark, f"{path}/members").collect()]
    assert Counter(found) == Counter([(1, "response", None, b"A"), (5, "revisit", 1, None), (5, "response", None, b"B"), (5, "response", None, b"B"), (None, "response", None, b"A")])
    empty = store.new_dir(spark, "w")
    warc.normalise(warc.write_archives(pages.limit(0), f"{empty}/whole"), f"{empty}/members")
    assert warc.read_records(spark, f"{empty}/members").count() == 0


def test_packing(spark):
    texts = ODD + prose(12) + ["word " * 5000]
    rows = packing.pack(make(spark, texts).repartition(3), BYTE, "bytes", end_id=0).collect()
    tokenizer = subwords.encoder(BYTE, "bytes").tokenizer
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == want.tobytes()
        at = 0
        for p in pieces:
            assert (p["start"], p["offset"], p["doc_tokens"], p["bucket"]) == (at, 0, len(want), p["length"].bit_length() - 1)
            assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= 1024
            at += p["length"]
        short = [p["length"] for p in pieces if p["length"] < 1024]
        assert short == sorted(set(short), reverse=True)
    assert packing.pack(make(spark, []), BYTE, "bytes", end_id=0).count() == 0
    path = store.new_dir(spark, "buckets")
    packing.write_buckets(packing.pack(make(spark, texts), BYTE, "bytes", end_id=0), path)
    back = packing.read_buckets(spark, path).collect()
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in back) == Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in rows)
    assert len({r["sequence_id"] for r in back}) == len(back)
    for bucket in {r["bucket"] for r in back}:
        assert {r["length"] for r in spark.read.parquet(f"{path}/bucket={bucket}").collect()} == {1 << bucket}


def test_language_id(spark):
    r = random.Random(13)
    words = {"en": ["the", "house", "with", "thing"], "fr": ["le", "maison", "avec", "chose"], "de": ["das", "haus", "mit", "ding"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 60))), lang) for i in range(450) for lang in [r.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(["", None, "123 !!", "the house"])], "doc_id long, text string, lang string")
    train, test = docs.where("doc_id % 4 <> 2"), docs.where("doc_id % 4 = 2").unionByName(odd)
    got = {r["doc_id"]: r for r in langid.predict(test, langid.train(train)).collect()}
    truth = [(got[i]["lang_pred"], lang) for i, _, lang in rows if i % 4 == 2]
    assert sum(a == b for a, b in truth) / len(truth) > 0.97
    for i in range(3):
        assert (got[1000 + i]["lang_pred"], got[1000 + i]["score"], got[1000 + i]["accepted"]) == ("und", 0.0, False)
    assert got[1003]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.predict(odd, langid.train(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_language_id_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    scored = langid.predict(docs.where("held"), langid.train(docs.where("not held")))
    right = scored.where("lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("accepted").cast("double"))).first()
    assert right[0] >= 0.95 and right[1] >= 0.99


def test_training_sample_is_the_smallest_hashes(spark):
    rows = [(i, f"word{i} " * (1 + i % 3), "ab"[i % 5 == 0]) for i in range(500)] + [(7, "same", "c")] * 40 + [(900, "x" * 9000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id", "text"))
    want = Counter()
    for lang in "abcd":
        want.update((lang, h) for h in sorted(r["h"] for r in docs.where(F.col("lang") == lang).collect())[:30])
    got = langid.training_rows(docs, 30).collect()
    assert Counter((r["lang"], r["h"]) for r in got) == want
    assert [len(r["text"]) for r in got if r["lang"] == "d"] == [langid.SPANS * (langid.SPAN_CHARS + 1) - 1]
    assert langid.training_rows(docs.limit(0)).count() == 0


def test_rows_with_repeated_and_null_ids(spark):
    """Every operator takes repeated and null ids with other or the same text, each as a row of its own."""
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten", None, "", "seven eight nine ten"]
    ids = [3, 3, 3, None, None, None]
    docs = store.staged(spark.createDataFrame(list(zip(ids, texts, ["a", "b", None] * 2, strict=True)), "doc_id long, text string, source string"), "ids")
    pairs = Counter((i, t or "") for i, t in zip(ids, texts, strict=True))
    path = store.new_dir(spark, "t")
    token_files.write_tokens(docs, path, WORD, "lower", end_id=1)
    assert Counter(r["doc_id"] for r in token_files.read_tokens(spark, path).collect()) == Counter(ids)
    assert Counter((r["doc_id"], r["n_chars"]) for r in fingerprints.compare_with_next(docs).collect()) == Counter((i, len(t)) for i, t in pairs.elements())
    assert Counter((r["doc_id"], r["text"] or "") for r in substrings.without_repeats(docs).collect()) == pairs
    groups = Counter((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert sum(groups.values()) == 6 and {c for _, f, c in groups if f == 0} == {None} and {c for _, f, c in groups if f != 0} == {3}
    assert Counter(r["doc_id"] for r in token_counts.count_tokens(docs, PIECE).collect()) == Counter(ids)
    assert Counter((r["doc_id"], r["text"] or "") for r in mixing.mix(docs).collect()) == pairs
    assert Counter(r["doc_id"] for r in packing.pack(docs, BYTE, "bytes", end_id=0).where("start = 0").collect()) == Counter(ids)
    assert Counter(r["doc_id"] for r in langid.predict(docs, langid.fit(["one", "sept"], ["en", "fr"])).collect()) == Counter(ids)
    vectors = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (21, [1.0, 1.0]), (None, [2.0, 2.0])], "vec_id long, embedding array<double>")
    found = [(r["query_id"], r["vec_id"]) for r in neighbours.nearest(vectors, vectors.where("vec_id = 20"), k=3).collect()]
    assert set(found) == {(20, 21)}
