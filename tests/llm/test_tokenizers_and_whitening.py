"""Operators 11 to 13 against the libraries, brute force and another solver, with odd rows."""

import base64
import bisect
import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import alignment, exact_spectrum, queries, rank_bpe, whitening

DATA = "/root/testdata/sf0.001"
RANKS, A_FILE, B_FILE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PIECES = [*"abcXYZ089 \n\t 　 '.,-", "…", "’", "é", "ß", "ж", "中", "文", "ा", "्", "ि", "́", "١", "'s", " 'll", "\x1c", "\x85", "​", "<|endoftext|>", "<s>", "<0x41>", "▁", "😀", " " * 20, "a" * 20, "\n " * 8, " the", " house", "ﬁ"]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


ODD_TEXTS = [None, "", " ", "word", "two words", " led", "tail ", "\n", "a\nb", "word " * 4000, "x" * 9000, "中文" * 3000, " " * 5000, "�", *texts(3, 300)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rank_bpe_pieces_have_the_ids_of_the_whole(library):
    for chunk in (1, 5, 17):
        enc = rank_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN, chunk=chunk)
        for text in texts(chunk, 1500):
            assert enc.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_rank_bpe_blanks_without_end():
    enc = rank_bpe.RankEncoder(RANKS, public_tokenizers.PATTERN)
    for text in ("two words" + " " * 1_500_000 + "x", "\n " * 800_000, "ab" * 400_000):
        assert enc.decode(enc.encode(text)) == text.encode()
    assert len(enc.encode(" " * 300_000 + "x")) == 300_000  # blanks have a rank each, the last joins the letter


def test_rank_bpe_rows(spark, library):
    docs = spark.createDataFrame([(i if i != 5 else None, t, 0, "x") for i, t in enumerate([*ODD_TEXTS, "same", "same"])], "doc_id long, text string, ids int, decoded string")
    tokens = rank_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = rank_bpe.decode(tokens, RANKS, public_tokenizers.PATTERN).collect()
    want = [(i if i != 5 else None, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate([*ODD_TEXTS, "same", "same"])]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [(r.doc_id, r.ids, bytes(r.decoded)) for r in sorted(got, key=key)] == sorted(want, key=key)
    half = spark.createDataFrame([(1, library.encode_ordinary("é")[:1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in rank_bpe.decode(half, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == ["é".encode(), b"", None]
    assert rank_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_rank_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op11_rank_bpe(spark, DATA).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    byte = alignment._byte_of()
    assert sorted(byte.values()) == list(range(256))
    vocabulary = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in a.get_vocab().items()}

    def spell_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    return (lambda t: [(i, vocabulary[i]) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, spell_b(i)) for i in b.encode(t)])


def brute(rows, sides):
    """One row a document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    cut = []
    for _, text in rows:
        groups = []
        if text:
            a, b = sides[0](text), sides[1](text)
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = [list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b)]
                both = sorted(set(ends[0]) & set(ends[1]))
                place = {high: [[], []] for high in both}
                for which, (side, at) in enumerate(zip((a, b), ends, strict=True)):
                    for (i, _), e in zip(side, at, strict=True):
                        place[both[bisect.bisect_left(both, e)]][which].append(i)
                groups = list(place.values())
        cut.append(groups)
    links = [Counter(pair for x, y in groups for pair in itertools.product(x, y)) for groups in cut]
    count = Counter(pair for found in links for pair in found)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), groups, found in zip(rows, cut, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(found.values()), sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()), shown))
    return out, count, best


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("links,fan_in,large", [(4_000_000, 64, 4096), (3000, 8, 4)])
def test_alignment_rows(spark, sides, monkeypatch, links, fan_in, large):
    for name, value in (("LINKS", links), ("FAN_IN", fan_in), ("LARGE", large)):
        monkeypatch.setattr(alignment, name, value)
    given = [(i if i != 7 else None, t) for i, t in enumerate([*ODD_TEXTS, "same text here", "same text here"])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in given], "doc_id long, text string, block int, groups string").repartition(5)
    found, pairs = alignment.align(docs, A_FILE, B_FILE)
    want, count, best = brute(given, sides)
    assert in_order(found.collect()) == in_order(want)
    assert {(r.a, r.b): (r["count"], r.is_best) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_alignment_of_nothing(spark):
    for some in ([], [(1, None), (None, "")]):
        found, pairs = alignment.align(spark.createDataFrame(some, "doc_id long, text string"), A_FILE, B_FILE)
        assert [tuple(r)[1:] for r in found.collect()] == [(0, 0, 0, 0, 0, 0, "")] * len(some)
        assert pairs.collect() == []


def test_alignment_query(spark, sides):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in brute(docs, sides)[0]]
    assert in_order(queries.op12_alignment(spark, DATA).collect()) == in_order(want)


def test_runs_merge_frame_by_frame(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 5)
    rng = np.random.default_rng(1)
    runs, want = [], Counter()
    for n in (0, 1, 7, 40, 40, 400):
        keys = np.unique(rng.integers(0, 90, n))
        counts = rng.integers(1, 9, len(keys))
        runs.append(alignment.put_run(keys, counts))
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] += c
    got = [(k, c) for ks, cs in alignment.merged(runs) for k, c in zip(ks.tolist(), cs.tolist(), strict=True)]
    assert got == sorted(want.items())


def spectrum(matrix, most=16):
    primes = exact_spectrum.primes(exact_spectrum.primes_needed(matrix))
    poly = exact_spectrum.combined([(p, exact_spectrum.polynomial_mod(matrix, p)) for p in primes])
    bits, roots = exact_spectrum.largest_roots(poly, most)
    values = [y / 2**bits for y, m in roots for _ in range(m)]
    return poly, values, [v for y, m in roots for v in exact_spectrum.eigenvectors(matrix, bits, y, m)]


def test_spectrum_of_known_matrices():
    poly, values, _ = spectrum([[2, 1], [1, 2]])
    assert poly == [1, -4, 3] and values == [3, 1]
    assert spectrum([[0, 0], [0, 0]])[1:] == ([], [])
    poly, values, vectors = spectrum(np.diag([5, 5, 5, 3, 0]).tolist())
    assert poly == [1, -18, 120, -350, 375, 0] and values == [5, 5, 5, 3]
    assert np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(4), atol=1e-15)
    # Two eigenvalues that doubles can't tell apart.
    _, values, vectors = spectrum([[10**20 + 1, 1], [1, 10**20 + 1]])
    assert np.allclose(np.abs(vectors), math.sqrt(0.5), atol=1e-15) and vectors[0] @ vectors[1] == pytest.approx(0, abs=1e-15)


def test_spectrum_against_another_solver():
    rng = np.random.default_rng(3)
    for d, n in ((1, 5), (6, 50), (12, 5), (20, 300)):
        z = rng.integers(-50, 50, (n, d))
        m = n * z.T @ z - np.outer(z.sum(0), z.sum(0))
        _, values, vectors = spectrum(m.tolist(), 8)
        want, basis = np.linalg.eigh(m.astype(float))
        k = len(values)
        assert k == min(8, np.linalg.matrix_rank(m))
        assert np.allclose(values, want[::-1][:k], rtol=1e-10)
        assert np.allclose(np.abs(np.array(vectors) @ basis[:, ::-1][:, :k]), np.eye(k), atol=1e-6)


VECTORS = "vec_id long, embedding array<float>, component string, x int"


def whitened_rows(df):
    return {(r.vec_id, r.component): r for r in df.collect()}


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.6, 0]).astype(np.float32)
    rows = [(i, v.tolist(), "c", 0) for i, v in enumerate(base)] + [(900 + i, base[0].tolist(), "c", 0) for i in range(50)]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf"), *[0.0] * 5])]
    df = spark.createDataFrame([*rows, *((i, v, "c", 0) for i, v in odd), (None, base[1].tolist(), "c", 0)], VECTORS).repartition(7)
    got = df.transform(whitening.whiten).collect()
    x = np.floor(base.astype(float) * 64).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    v = np.cov(distinct.T.astype(float), bias=True)
    e, basis = np.linalg.eigh(v)
    e, basis = e[::-1], basis[:, ::-1]
    assert len(got) == 5 * (300 + 50 + 1)  # the last dimension has no variance
    assert {r.vec_id for r in got} == {*range(300), *range(900, 950), None}
    for r in got:
        i = 1 if r.vec_id is None else 0 if r.vec_id >= 900 else r.vec_id
        k = r.component - 1
        assert (r.n, r.deviation) == (n, int(((n * x[i] - s) ** 2).sum()))
        assert r.explained == pytest.approx(e[k] / v.trace(), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs((x[i] - s / n) @ basis[:, k]) / math.sqrt(e[k]), abs=1e-8)
        assert r.identity_error < 1e-10


def test_whitening_of_ties_and_nothing(spark):
    # The corners of a square: both eigenvalues are equal.
    square = spark.createDataFrame([(i, [a, b], "c", 0) for i, (a, b) in enumerate(itertools.product((-1.0, 1.0), repeat=2))], VECTORS)
    got = whitened_rows(whitening.whiten(square))
    assert len(got) == 8 and all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-12 for r in got.values())
    assert all(got[i, 1].whitened ** 2 + got[i, 2].whitened ** 2 == pytest.approx(2) for i in range(4))
    for rows in ([], [(1, None, "c", 0)], [(1, [1.0, 2.0], "c", 0), (2, [1.0, 2.0], "c", 0)]):
        df = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "c", 0), (2, [1.0], "c", 0)], VECTORS))


def test_whitening_beyond_doubles(spark):
    # Entries so large that products of them need more than 53 bits.
    rows = [(i, [float(2**22 + i), float(2**22 - i * i), float(i % 3)], "c", 0) for i in range(40)]
    got = whitened_rows(whitening.whiten(spark.createDataFrame(rows, VECTORS.replace("float", "double"))))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v, *_ in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert all(got[i, 1].deviation == sum((40 * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(40))
    assert got[0, 1].identity_error < 1e-9


def test_whitening_query(spark):
    df = queries.op13_whitening(spark, DATA)
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where(whitening.usable(F.col("embedding"))).collect()
    base = np.floor(np.array([r.embedding for r in rows], float) * 64)
    e, basis = np.linalg.eigh(np.cov(np.unique(base, axis=0).T, bias=True))
    got = whitened_rows(df)
    assert len(got) == 16 * len(rows)
    centred = (base - np.unique(base, axis=0).mean(axis=0)) @ basis[:, ::-1][:, :16] / np.sqrt(e[::-1][:16])
    for r, want in zip(rows, centred, strict=True):
        assert [abs(got[r.vec_id, k + 1].whitened) for k in range(16)] == pytest.approx(np.abs(want).tolist(), abs=1e-6)
