"""Centroids, token counts and periodic runs against plain loops, brute force and the library."""

import hashlib
import random
import time
from fractions import Fraction
from math import floor

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from regionlytics.llm import centroids as ct
from regionlytics.llm import periodic_runs as pr
from regionlytics.llm import token_counts as tc
from regionlytics.llm.queries import queries, with_planted_run

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, 1, [1], "c", 7) for i, t in rows], "doc_id long, text string, n_words long, runs array<int>, collapsed string, n_bytes long")


# Centroids


def plain_lloyd(rows, k, rounds, scale, width, seed=1):
    kept = [(i, [floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) < ct.TOO_FAR for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == n]:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i if i is not None else -1, near(v)[1], near(v)[0]) for i, v in kept)), centroids


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 5, "x", b"d") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster long, id string, data binary")


@pytest.mark.parametrize(("kind", "spread"), [("float", 1.0), ("double", 1e5), ("double", 0.02)])
def test_lloyd_against_plain_loops(spark, kind, spread):
    r = random.Random(spread)
    rows = [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(4)]) for i in range(150)]
    rows += [(r.randrange(150), rows[r.randrange(150)][1]) for _ in range(60)] + [(None, [0.5] * 4), (None, [0.25] * 4)]
    rows += [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 1.0, 1.0]), (6, [float("nan")] * 4), (7, [float("inf")] + [0.0] * 3), (8, [1e30] * 4), (9, [-1e30] * 4), (10, [-0.0] * 4)]
    if kind == "double":
        rows.append((11, [1.7e308] * 4))
    out, centroids = ct.lloyd(vectors(spark, rows, kind).repartition(5), k=7, rounds=3, width=4)
    want, final = plain_lloyd(rows, 7, 3, 64, 4)
    assert sorted((x["vec_id"] if x["vec_id"] is not None else -1, x["cluster"], x["distance"]) for x in out.collect()) == want
    assert centroids.tolist() == final


def test_lloyd_with_fewer_rows_ties_and_nothing(spark):
    same = [(i, [1.0, 1.0]) for i in range(5)]
    out, centroids = ct.lloyd(vectors(spark, same), k=3, width=2)
    assert {x["cluster"] for x in out.collect()} == {0} and centroids.tolist() == [[64, 64]] * 3
    out, centroids = ct.lloyd(vectors(spark, same[:2]), k=3, width=2)
    assert len(centroids) == 2 and out.count() == 2
    for rows in ([], [(1, None), (2, [1.0])]):
        out = ct.with_inertia(*ct.lloyd(vectors(spark, rows), k=3, width=2))
        assert out.count() == 0 and out.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_inertia_sums_distances(spark):
    rows = spark.createDataFrame([(1, 0, 5), (2, 0, 7), (3, 2, 1), (4, 1, 1 << 62), (5, 1, 1 << 62)], "vec_id long, cluster int, distance long")
    got = {x["vec_id"]: (x["cluster_inertia"], x["inertia"], x["centroid_sha256"]) for x in ct.with_inertia(rows, np.array([[-1, 2], [0, 0], [3, 4]])).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (12, None, sha("-1,2")), 2: (12, None, sha("-1,2")), 3: (1, None, sha("3,4")), 4: (None, None, sha("0,0")), 5: (None, None, sha("0,0"))}


# Token counts


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def counter():
    return tc.TokenCounter(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" ▁\n\tab<s>é漢😀͸\x00.0", max_size=120)))
def test_counts_as_the_library(sp, counter, t):
    if "\ud800" <= max(t, default="") <= "\udfff":
        return
    assert counter.text(t) == len(sp.encode(t))


def test_counts_of_pieces_and_long_words(sp, counter):
    r = random.Random(3)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, sp.get_piece_size())]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 60))) for _ in range(300)]
    texts += ["".join(r.choices(alphabet, k=3000)) for alphabet in ("ab", "a", " ", " \n", "the ", "０1漢") for _ in range(2)]
    assert [counter.text(t) for t in texts] == list(map(len, sp.encode(texts)))
    began = time.time()
    for t in (" " * 300_000, "ab" * 100_000, "x" + " " * 200_000 + "y"):
        assert counter.text(t) == len(sp.encode(t))
    assert time.time() - began < 60


def test_token_counts_table(spark, sp, monkeypatch):
    long = "lorem ipsum " * 20_000
    rows = [(1, "some text"), (1, "some text"), (2, None), (3, ""), (None, " "), (4, long), (5, "<s>é</s><unk>")]
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_tokens"]) for x in tc.count_tokens(docs(spark, rows), PIECES).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    assert tc.count_tokens(docs(spark, []), PIECES).count() == 0
    small = tc.TokenCounter(PIECES)
    monkeypatch.setattr(tc, "REMEMBER", 5)
    assert [small.text(t) for t in ("a b c d e f g", "h i j", "a b")] == [len(sp.encode(t)) for t in ("a b c d e f g", "h i j", "a b")]


def test_token_counts_query_against_the_library(spark, sp):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op12_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(sp.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


# Periodic runs


def plain_runs(w):
    """For each period the stretches of words equal to the word a period on, if no smaller period fits them."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            part = w[start : start + length]
            if i > start and length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(r):
    w = [r.choice("abcdefghijklmnopqrst"[: r.choice([1, 2, 2, 3, 5, 20])]) for _ in range(r.randrange(90))]
    if r.random() < 0.6 and w:
        a = r.randrange(len(w))
        p = 1 + (len(w) - a) // r.randrange(3, 11)
        w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
    return (w * r.choice([1, 1, 2, 5]))[:300]


@pytest.mark.parametrize("bulk", [0, 1, 3, 6, 20])
def test_runs_against_brute_force(monkeypatch, bulk):
    monkeypatch.setattr(pr, "BULK", bulk)
    r = random.Random(bulk)
    for _ in range(120):
        texts = [words(r) for _ in range(r.randrange(1, 8))]
        assert pr.find_runs(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=4))
def test_runs_of_two_words_against_brute_force(texts):
    assert pr.find_runs([list(t) for t in texts]) == [plain_runs(list(t)) for t in texts]


def test_runs_of_long_texts_take_time_in_proportion():
    began, n = time.time(), 200_000
    assert pr.find_runs([["a"] * n, [], ["a", "b"] * (n // 2)]) == [[(0, n, 1)], [], [(0, n, 2)]]
    assert pr.find_runs([[str(i % 40_000) for i in range(n)]]) == [[(0, n, 40_000)]]
    assert pr.find_runs([[str(i % (n // 3)) for i in range(n)]]) == [[]]
    assert time.time() - began < 30


def test_collapsed_keeps_the_first_period():
    w = "x a b a b a b a b y".split()
    assert pr.collapsed(w, pr.find_runs([w])[0]) == "x a b y".split()
    w = list("aaaaaabaaaaaabaaaaaabaaaaaab")
    assert pr.find_runs([w])[0] == [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]
    assert pr.collapsed(w, pr.find_runs([w])[0]) == list("ab")


def test_periodic_runs_table(spark, monkeypatch):
    rows = [(1, "a b  a\tb a b a b"), (1, "a b  a\tb a b a b"), (2, None), (3, " \n"), (None, "x x x x x x"), (4, "one two three"), (5, "w " * 50_000)]
    want = sorted([(1, 8, [(0, 8, 2)], "a b")] * 2 + [(2, 0, [], ""), (3, 0, [], ""), (0, 6, [(0, 6, 1)], "x"), (4, 3, [], "one two three"), (5, 50_000, [(0, 50_000, 1)], "w")])
    for many in (1, 10, pr.MANY):
        monkeypatch.setattr(pr, "MANY", many)
        got = pr.periodic_runs(docs(spark, rows)).collect()
        assert sorted((x["doc_id"] or 0, x["n_words"], [tuple(y) for y in x["runs"]], x["collapsed"]) for x in got) == want
    assert pr.periodic_runs(docs(spark, [])).count() == 0


def test_periodic_runs_query_against_brute_force(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for x in queries()["op13_periodic_runs"](spark, SF).collect():
        w = with_planted_run(x["doc_id"], pr.WORDS.findall(texts[x["doc_id"]]))
        if len(w) > 600:
            continue  # the SQL compares these
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None, None, None))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(v for i, v in enumerate(w) if i not in gone)
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *best)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert (x["runs_sha256"], x["collapsed_sha256"]) == (sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))
