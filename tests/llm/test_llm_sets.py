"""Exact and near copies, lines, vectors, mixtures and the pipeline against brute force."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlytics.llm import embed_join as ej
from regionlytics.llm import exact_dedup as xd
from regionlytics.llm import line_dedup as ld
from regionlytics.llm import mixing as mx
from regionlytics.llm import ngram_join as nj
from regionlytics.llm.common import connected_components
from regionlytics.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(*r, *["x"] * (3 - len(r)), 1, b"c", [1]) for r in rows], "doc_id long, text string, source string, n long, fp binary, sets array<int>")


def groups(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("name", [n for n in sorted(oracle_sql()) if n in queries()])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in got.fetchall())


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200)] + [(r.randint(300, 340), r.randint(300, 340)) for _ in range(30)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(400, links)
    assert got == {n: want[n] for a, b in links for n in (a, b) if a != b}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 64, 5000, np.uint64, endpoint=False)
    x = np.r_[x, x[:700], x[:300]]
    parts = np.array_split(rng.permutation(x), 7)
    f = xd.CountingQuotientFilter.of(parts[0])
    for p in parts[1:]:
        f = xd.CountingQuotientFilter.from_bytes(f.merge(xd.CountingQuotientFilter.of(p)).to_bytes())
    fp, n = np.unique(x, return_counts=True)
    assert (f.fingerprints() == fp).all() and (f.counts == n).all()
    assert f.count(int(x[0])) == 3 and f.count(12345) == int((x == 12345).sum())
    assert len(xd.CountingQuotientFilter.from_bytes(xd.CountingQuotientFilter.of(x[:0]).to_bytes()).remainders) == 0


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (3, "a"), (None, "b"), (None, "z"), (7, "long " * 30_000), (8, "long " * 30_000)]


def test_exact_dedup(spark):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in xd.exact_dedup(docs(spark, ROWS)).collect()), key=str)
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    assert got == sorted(want, key=str)
    assert xd.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_survives_shared_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in xd.exact_dedup(docs(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc")])).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (2, 50, 3), (1, 60, 4)])
def test_near_duplicates_against_all_pairs(spark, width, percent, seed):
    r = random.Random(seed)
    texts = [None, "", " \n", "A b", "a B", "a b c"]
    for _ in range(12):
        base = [f"w{r.randint(0, 60)}" for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"v{r.randint(0, 9)}"
            texts.append(" ".join(w))
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = {i: (len(sets[i]), c) for i, c in enumerate(groups(len(texts), links))}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in nj.near_duplicates(docs(spark, list(enumerate(texts))), width=width, percent=percent).collect()}
    assert got == want


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_near_duplicates_with_more_stars(spark, monkeypatch, rounds):
    monkeypatch.setattr(nj, "PAIRS_PER_POSTING", 0)
    monkeypatch.setattr(nj, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(nj, "TASK_PAIRS", 2)
    test_near_duplicates_against_all_pairs(spark, 2, 50, 9)


def test_pairs_grow_with_a_group_of_near_copies_not_with_its_square(spark, monkeypatch):
    counted = []
    verified = nj._verified
    monkeypatch.setattr(nj, "_verified", lambda pairs, *a: counted.append(pairs.count()) or verified(pairs, *a))

    def made(copies):
        r = random.Random(copies)
        base = [f"b{r.randrange(10**9)}" for _ in range(250)]
        texts = [" ".join(base)]
        for i in range(copies):
            w = list(base)
            for at in r.sample(range(250), 1 + i % 10):
                w[at] = f"c{r.randrange(10**9)}"
            texts.append(" ".join(w))
        counted.clear()
        sizes = nj.near_duplicates(docs(spark, list(enumerate(texts))), width=5, percent=80).groupBy("component_id").count()
        assert sizes.where("component_id = 0").first()["count"] > copies * 0.4
        return sum(counted)

    few, many = made(300), made(600)
    assert few < 2 * 300 and many < 2.5 * few


def test_near_duplicates_of_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(5, t), (5, t), (9, t + " x"), (None, t), (7, "else " + t.replace("w", "q"))]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 26, 5), (5, 26, 5), (9, 27, 5), (None, 26, None), (7, 27, 7)], key=str)
    assert nj.near_duplicates(docs(spark, [])).count() == 0


def test_shingles_in_pieces(monkeypatch):
    r = random.Random(5)
    texts = [bytes(r.choices(b"aAbB \t\n", k=r.randint(0, 300))) for _ in range(200)]
    whole = nj.shingle_sets(texts, 4)
    assert [len(s) for s in whole] == [len(shingles(t.decode(), 4)) for t in texts]
    monkeypatch.setattr(nj, "PIECE", 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, nj.shingle_sets(texts, 4), strict=True))


def test_range_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ej, "TASK_HOME", 30)
    monkeypatch.setattr(ej, "TASK_HELD", 50)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x[100:200] = x[:100] + rng.normal(size=(100, 8)) * 0.15
    x[200:230] = x[0] * rng.uniform(0.5, 2, 30)[:, None]
    x[230:240] = x[5]
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    odd = [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [1.0, None] * 4), (405, [float("inf")] + [1.0] * 7), (406, [1.0]), (407, [2.0]), (None, rows[0][1])]
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = v @ v.T
    links = [(i, j) for i in range(400) for j in range(i) if cos[i, j] >= 0.95] + [(406, 407)]
    comp, n = groups(408, links), np.zeros(408, int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    d = spark.createDataFrame([(i, e, 1, b"x") for i, e in rows + odd], "vec_id long, embedding array<float>, m int, data binary")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in ej.range_join(d).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in range(408)}
    assert ej.range_join(d.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(r, t, k):
    b = list(t)
    for _ in range(k):
        i, how = r.randint(0, len(b)), r.randint(0, 2)
        if how == 0 or i == len(b):
            b.insert(i, r.choice("abé"))
        elif how == 1:
            del b[i]
        else:
            b[i] = r.choice("abé")
    return "".join(b)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    r = random.Random(most)
    rows = [(a, edited(r, a, r.randint(0, 5))) for a in ("".join(r.choices("abé😀", k=r.randint(0, 16))) for _ in range(400))]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select("a", "b", ld.within(ld.characters(F.col("a")), ld.characters(F.col("b")), most).alias("w")).collect()
    assert all(x["w"] == (distance(x["a"], x["b"]) <= most) for x in got)


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(7)
    bases = ["".join(r.choices("abcdé ", k=r.randint(15, 40))).replace("\n", " ") for _ in range(12)]
    texts = [None, "", "\n\n", "short\nshort"] + ["\n".join(edited(r, r.choice(bases), r.randint(0, 3)) for _ in range(r.randint(1, 5))) for _ in range(25)]
    lines = [(d, i, x) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))]
    links = [(p, q) for p in range(len(lines)) for q in range(p) if (a := lines[p][2]) and (b := lines[q][2]) and (a == b or min(len(a), len(b)) >= 20 and distance(a, b) <= 2)]
    comp = groups(len(lines), links)
    want = {d: [i for k, (e, i, _) in enumerate(lines) if e == d and comp[k] != k] for d in range(len(texts))}
    got = {x["doc_id"]: (x["n_lines"], x["n_kept"], x["dropped_lines"]) for x in ld.near_duplicate_lines(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {d: (len((t or "").split("\n")), len((t or "").split("\n")) - len(want[d]), want[d]) for d, t in enumerate(texts)}


def test_line_dedup_edge_cases(spark):
    line = "a line of more than twenty characters"
    rows = [(2, line), (2, line), (None, line), (3, line + "!"), (4, "x" * 50_000)]
    got = sorted(((x["doc_id"], x["n_kept"]) for x in ld.near_duplicate_lines(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 1), (2, 1), (None, 1), (3, 0), (4, 1)], key=str)
    assert ld.near_duplicate_lines(docs(spark, [])).count() == 0


def test_native_operator_runs_no_python(spark):
    plan = ld.near_duplicate_lines(docs(spark, [(1, "a\nb")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def water_level(sizes, share=1.5, most=2.0):
    """Targets of sources in order, sharing by weight and giving the excess back until none is above its cap."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, capped, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = left - sum(most * sizes[i] for i in capped)
        for i in free:
            target[i] = rest * w[i] / sum(w[j] for j in free)
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = most * sizes[i]
            capped.add(i)


def test_mixture(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)) if i % 9 else None, r.choice(["b", "a", "c", None, "é"])) for i in range(300)] + [(1, "one two", "a"), (None, "three", "a")]
    placed, pieces = mx.mix(docs(spark, rows), block_words=16)
    got = placed.join(pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")), "row", "left").na.fill(0, ["taken"])
    by = {x["source"]: x for x in got.groupBy("source").agg(F.sum("size").alias("s"), F.max("target").alias("t"), F.sum("taken").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    order = sorted((s for s in by if s is not None)) + [None]
    want = water_level([by[s]["s"] for s in order])
    for s, t in zip(order, want, strict=True):
        assert by[s]["t"] == pytest.approx(t) and by[s]["n"] == round(t) and by[s]["over"] <= 0
    slots = pieces.select("slot", "pick").distinct().count()
    assert slots == pieces.select("slot").distinct().count()
    again = mx.mix(docs(spark, rows), block_words=16)[1]
    key = lambda d: sorted((x["slot"], x["from_word"], x["to_word"]) for x in d.collect())
    assert key(again) == key(pieces)
    assert mx.mix(docs(spark, []))[1].count() == 0
    assert mx.mix(docs(spark, [(1, None, None), (2, "", "a")]))[1].count() == 0


def test_schedule_spreads_sources(spark):
    b = spark.createDataFrame([(0, 700), (1, 0), (2, 200), (3, 100)], "r int, n_blocks long")
    s = mx.schedule(b).orderBy("slot").collect()
    assert len(s) == 1000
    for r, n in ((0, 700), (2, 200), (3, 100)):
        mine = [x["pick"] for x in s if x["r"] == r]
        assert mine == list(range(n))
        for part in range(1, 11):
            seen = sum(x["r"] == r for x in s[: part * 100])
            assert abs(seen - part * n / 10) < 12


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sf = "/root/testdata/sf0.01"
    columns, before = d.columns, d
    for name, f in cp.STAGES:
        out = f(spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert out.columns == columns
        a, b = before.toPandas(), out.toPandas()
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
            good = set(labels[labels.quality == 1].doc_id) & set(a.doc_id)
            assert len(good & set(b.doc_id)) / len(good) > 0.98
        if name == "exact":
            assert sorted(b.doc_id) == sorted(a.fillna({"text": ""}).groupby("text").doc_id.max())
        if name == "near":
            sets = [shingles(t, 5) for t in a.text]
            at: dict = {}
            for i, s in enumerate(sets):
                for x in s:
                    at.setdefault(x, []).append(i)
            pairs = {(i, j) for v in at.values() for i in v for j in v if j < i}
            links = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            order = a.doc_id.rank().astype(int) - 1
            comp = groups(len(a), [(order[i], order[j]) for i, j in links])
            ids = sorted(a.doc_id)
            assert sorted(b.doc_id) == [ids[i] for i in range(len(ids)) if comp[i] == i]
        if name == "mixture":
            assert b.doc_id.value_counts().max() <= 2 and set(b.doc_id) <= set(a.doc_id)
        if name == "tokens":
            assert sorted(b.doc_id) == sorted(a.doc_id) and (b.n_tokens == b.ids.map(len)).all()
        before = out
    assert cp.exact(spark, docs(spark, [(1, "a"), (1, "a"), (None, "b"), (2, "a"), (2, "a")]), sf).count() == 2


def odd_documents(spark):
    """Good and bad texts, some under one id or none, with near copies among them; the columns of documents and one that clashes."""
    r = random.Random(21)
    rows = []
    for i in range(160):
        good = i % 4 != 0
        text = " ".join(r.choice(["the", "reading", "of", "several", "letters", "makes", "sense"]) + str(i) * (k % 5 == 0) for k in range(60)) if good else "!! $$ " * 40 + str(i)
        doc = None if i % 8 < 2 else i // 8 if i % 8 == 2 else i
        rows.append((doc, text, "en", "abc"[i % 3], len(text), i))
        if i % 10 == 1:
            rows.append((None if i % 20 == 1 else 1000 + i, text + " more", "en", "b", 1, 500 + i))
    rows += [(7, None, "en", "a", 0, 900), (None, "", None, None, 0, 901)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int")


def test_pipeline_keeps_to_rows_whatever_their_ids(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline as cp
    from regionlytics.llm import quality as ql

    d = odd_documents(spark)
    labels = d.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("text").startswith("!!"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    judged = {x["_row"]: x["kept"] for x in ql.classify(d, labels, row_col="_row").collect()}
    out = cp.quality(spark, d, str(tmp_path))
    assert out.columns == d.columns
    kept = {x["_row"]: (x["doc_id"], x["text"]) for x in out.collect()}
    assert set(kept) == {i for i, k in judged.items() if k} and not any((t or "").startswith("!!") for _, t in kept.values())
    assert {x["_row"] for x in d.collect() if x["text"] and not x["text"].startswith("!!")} <= set(kept)

    left = cp.near(spark, out, "")
    assert left.columns == d.columns
    order = sorted(kept, key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    sets = [shingles(kept[i][1], 5) for i in order]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = groups(len(sets), links)
    got = sorted(x["_row"] for x in left.collect())
    classes = {}
    for k, i in enumerate(order):
        classes.setdefault(comp[k], []).append(i)
    # which one stays is set by the ids; of equal or null ids any
    for members in classes.values():
        stays = [i for i in members if i in got]
        assert len(stays) == 1 and kept[stays[0]][0] == kept[members[0]][0]
    assert len(got) == len(classes) and len(links) > 10

    made = cp.tokens(spark, left, "")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(cp.TOKENIZER))
    assert sorted((str(x["doc_id"]), x["ids"]) for x in made.collect()) == sorted((str(kept[i][0]), sp.encode(kept[i][1] or "")) for i in got)


def test_pipeline_mixture_takes_each_row_by_its_own_words(spark, monkeypatch):
    from collections import Counter

    import corpus_pipeline as cp

    r = random.Random(8)
    rows = [(None if i % 3 == 0 else i // 5 if i % 3 == 1 else i, f"t{i} " + "w " * r.randint(0, 3000), r.choice("abcd")) for i in range(120)] + [(None, None, "a"), (None, "", "b"), (7, None, "c")]
    d, made = docs(spark, rows), []
    monkeypatch.setattr(cp, "mix", lambda *a, **k: made.append(mx.mix(*a, **k)) or made[-1])
    out = cp.mixture(spark, d, SF)
    assert out.columns == d.columns
    got = Counter((x["doc_id"], x["text"], x["source"]) for x in out.collect())
    taken = {x["row"]: x["n"] for x in made[0][1].groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()}
    want = Counter()
    for x in made[0][0].select("row", "id", "source", "size").join(cp._numbered(d)[0].withColumnRenamed("_row", "row").select("row", "text"), "row").collect():
        if x["size"]:
            assert x["size"] == len(x["text"].split())
            want[x["id"], x["text"], x["source"]] += int(taken.get(x["row"], 0) / x["size"] + 0.5)
    assert got == +want
    assert sum(n for (i, _, _), n in got.items() if i is None) > 20 and max(got.values()) == 2
