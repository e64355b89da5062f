"""URL filter, classifiers, neighbours, the similarity join and the pipeline: held-out accuracy, recall and brute force."""

from __future__ import annotations

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import jaccard, neighbours, quality, registry, toxicity, urls
from rankloom.llm.components import components

# --- urls -------------------------------------------------------------------------------------

URLS = [
    (1, "http://a.example.net/en/1?x=1", "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "https://EXAMPLE.net/fr/#t", "example.net", "/fr/", "net/", "block"), (3, "http://x.example.com/de/9", "x.example.com", "/de/9", "example.com/de/", "block"),
    (4, "http://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), (5, "http://net", "net", "", None, None), (6, "http://notexample.com/de/", "notexample.com", "/de/", None, None), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None),
    (9, "", "", "", None, None), (10, "a://b://c.net/d", "b:", "//c.net/d", None, None), (11, "http://ÄÖ.Example.NET?q/x", "ÄÖ.example.net", "", None, None), (12, "x" * 5000 + "://long.net/" + "y/" * 3000, "long.net", "/" + "y/" * 3000, "net/", "block"),
]


def test_rules_hosts_and_paths(spark):
    rows = [(i, u, "clash") for i, u, *_ in URLS] + [(1, URLS[0][1], "clash"), (None, "http://q.net/", "clash")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string"))
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_without_or_with_one_verdict(spark):
    of = lambda *texts: {r["verdict"] for r in urls.judge(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, url string")).collect()}
    assert of("http://a.com/", "b") == {"allow"} and of("http://a.net/", "http://b.com/") == {"block"}


def test_trees_learn_lexical_differences(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 2
        path = "/".join(str(rng.randint(10**8, 10**9)) for _ in range(6)) if bad else "about"
        rule = i % 3 > 0  # two thirds are labelled by rules, on either verdict
        host = ("spam.net" if bad else "good.org") if rule else "other.com"
        rows.append((i, f"http://{host}{'/fr' if rule and not bad else ''}/{path}", bad))
    frame = spark.createDataFrame(rows, "page_id long, url string, bad int")
    out = urls.judge(frame).join(frame.select("page_id", "bad"), "page_id").where("rule IS NULL")
    assert out.count() == 200
    assert out.where((F.col("verdict") == "block") == (F.col("bad") == 1)).count() >= 180


# --- classifiers ------------------------------------------------------------------------------

ODD = [None, "", " ", "!!!", "a", "z" * 20_000, "é ñ 日本", "a|b|c", "\n\n"]


def test_lookup_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=20, pairs=2, pair_rounds=60)
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = registry.op4_quality(spark, sf_dir).toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()
    held = out[out["held_out"]].merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = registry.op9_toxicity(spark, sf_dir).toPandas()
    assert list(out.columns)[:4] == ["doc_id", "held_out", "score", "predicted"]
    held = out[out["held_out"]].merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() <= 0.01 * len(held)
    toxic = held[held["toxic"] == 1]
    assert (toxic["predicted"] == 1).mean() >= 0.85


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_odd_rows_are_scored(spark, which):
    docs = spark.createDataFrame([(i, t, 0.1, 1) for i, t in enumerate(ODD)] + [(1, "", 0.1, 1), (None, "x", 0.1, 1)], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    classify = quality.classify if which == "quality" else toxicity.classify
    out = classify(docs, labels)
    rows = out.collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert classify(docs, labels.limit(0)).count() == len(ODD) + 2
    assert classify(docs.limit(0), labels).count() == 0


def corpus(spark, words=("idiot", "moron", "stupid")):
    rng = random.Random(4)
    plain = ["the", "and", "house", "river", "stone", "people", "idle", "motor", "student", "more", "on", "sticky", "rapid"]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            text[5], text[20] = rng.choice(words), rng.choice(words)
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["1d10t", "m0r0n", "stup1d", "i d i o t", "m.o.r.o.n", "stuuupid", "$tup!d"]
    rows += [(1000 + k, f"the river {w} people and the stone house") for k, w in enumerate(hidden)]
    rows += [(2000, "the river 2 people and 100 stone houses at 7am www.a.b"), (2001, "a b c motor student")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguised_words_are_restored_and_scored(spark):
    docs, labels = corpus(spark)
    rows = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    for k, want in enumerate(["idiot", "moron", "stupid", "idiot", "moron", "stupid", "stupid"]):
        assert want in rows[1000 + k]["restored"], (want, rows[1000 + k]["restored"])
        assert rows[1000 + k]["predicted"] == 1
    assert rows[2000]["predicted"] == 0 and rows[2001]["predicted"] == 0


def test_signs_beside_each_other_and_at_the_end_are_restored(spark):
    docs, labels = corpus(spark, ("asshole", "stoopid", "die", "shit"))
    hidden = {"a$$hole": "asshole", "st00pid": "stoopid", "di3": "die", "sh1+": "shit", "(SH1+).": "shit", "d1e!!": "die", "4sshole": "asshole"}
    rows = [(3000 + k, f"the river {w} people and the stone house") for k, w in enumerate(hidden)] + [(4000, "the river!! people$$$ and 100 stone houses at 7am + more|rapid")]
    docs = docs.where("doc_id < 1000").union(spark.createDataFrame(rows, docs.schema))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    for k, want in enumerate(hidden.values()):
        assert want in got[3000 + k]["restored"] and got[3000 + k]["predicted"] == 1, (want, got[3000 + k])
    assert got[4000]["predicted"] == 0


def test_a_token_counts_each_mark_once():
    model = toxicity.smooth(toxicity.trigram_counts(pa.array(["stupid stupidi"] * 9)).reshape(28, 28, 28).astype(float))
    for text in ("stupid!", "stup1d!", "stupid5", "stup1d!!."):
        _, hashes, _, _ = toxicity.marks(pa.array([text]), model)
        assert (np.unique(hashes, return_counts=True)[1] == 1).all(), text


def test_decoder_finds_the_best_path_of_all():
    rng = np.random.default_rng(2)
    model = toxicity.smooth(rng.integers(0, 50, (28, 28, 28)).astype(float))
    for token in ("1d10t", "a$$", "l33t", "b00k", "heeello", "i.d.k", "5t0n3", "4|1"):
        best = []
        stack = [("", 0.0, 0, 0, 0)]
        places = toxicity.lattice(token)
        while stack:
            text, total, a, b, k = stack.pop()
            if k == len(places):
                best.append((total + model[a, b, 0], text))
                continue
            for letters, chance in places[k]:
                x, y, value = a, b, total + chance
                for c in letters:
                    s = toxicity.symbol(c)
                    value += model[x, y, s]
                    x, y = y, s
                stack.append((text + letters, value, x, y, k + 1))
        assert toxicity.restore(token, model) == max(best)[1]


def test_language_model_counts_all_texts(spark):
    texts = ["abc", "", None, "ab ab"]
    counts = toxicity.trigram_counts(pa.array(texts, pa.string())).reshape(28, 28, 28)
    assert counts[0, 1, 2] == 3 and counts[1, 2, 3] == 1 and counts[1, 2, 0] == 2
    model = toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(np.exp(model).sum(2), 1) and model[0, 1, 2] > model[0, 1, 3]


# --- neighbours -------------------------------------------------------------------------------


def test_recall_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    out = registry.op10_nearest(spark, sf_dir).toPandas()
    data = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    x, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        mine = out[out["query_id"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine["score"].is_monotonic_decreasing
        assert np.allclose(mine["score"], x[np.searchsorted(ids, mine["vec_id"])] @ x[q])
        hits += len(set(want) & set(mine["vec_id"]))
        total += 20
    assert hits / total >= 0.9


def test_buckets_are_visited_in_the_order_of_their_success():
    """Perturbations come by falling estimated success, as a direct sum over their hashes gives it."""
    hashing = neighbours.Hashing(hashes=4, success=0.5)
    own, logs = neighbours.chances(np.array([[0.1, 1.2, 2.3, -0.4], [5.0, 0.0, 1.0, 2.0]]), hashing)
    moves = neighbours.steps(4)
    order, visits = neighbours.visiting_order(logs, moves, hashing.success)
    assert own.tolist() == [[0, 0, 0, -1], [2, 0, 0, 0]] and len(moves) == 81
    for i in range(2):
        total = [sum(logs[i, h, m + 1] for h, m in enumerate(move)) for move in moves]
        assert np.allclose([total[k] for k in order[i]], sorted(total, reverse=True))
        seen = np.exp([total[k] for k in order[i]])
        assert seen[: visits[i]].sum() >= 0.5 * seen.sum() > seen[: visits[i] - 1].sum()
    # A place at the lower edge of its bucket has the bucket below as its likeliest perturbation.
    assert moves[order[0, 1]].tolist() == [-1, 0, 0, 0] or moves[order[0, 1]].tolist() == [0, 0, 1, 0]


@pytest.mark.parametrize("leading", [0, 2, 8])
def test_visited_buckets_are_those_of_the_order(leading):
    """Buckets are told by one bound a query, without listing the perturbations of each query in each cell."""
    hashing, rng = neighbours.Hashing(), np.random.default_rng(2)
    own, logs = neighbours.chances(rng.normal(0, 2, (40, 8)), hashing)
    moves, front = neighbours.steps(8), neighbours.steps(leading)
    order, visits = neighbours.visiting_order(logs, moves, hashing.success)
    bounds, goes = neighbours.least_chances(logs, hashing.success, leading, together=7)
    for i in range(40):
        wanted = moves[order[i, : visits[i]]]
        floors = np.vstack([own[i] + moves, own[i] + 2])
        got = neighbours.visited_buckets(own[i : i + 1], logs[i : i + 1], bounds[i : i + 1], floors)[0]
        assert not got[-1] and {*map(tuple, moves[got[:-1]])} == {*map(tuple, wanted)}
        assert {*map(tuple, front[goes[i]])} == {*map(tuple, wanted[:, :leading])}


def test_clustered_vectors_need_few_buckets(spark):
    """Where vectors lie in groups, queries meet little else than their own group."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 60, 0) + 0.05 * rng.normal(size=(2400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scored = []
    hashing = neighbours.Hashing(distance=0.15)
    largest = float(np.linalg.norm(x, axis=1).max())
    ids = np.arange(2400)
    q = ids % 20 == 0
    for t in range(hashing.tables):
        a, b = hashing.projections(33)
        own, logs = neighbours.chances(neighbours.unit(x[q]) @ a[t].T + b[t], hashing)
        order, visits = neighbours.visiting_order(logs, neighbours.steps(8), hashing.success)
        codes = neighbours.codes(np.floor((neighbours.lift(x, largest) @ a[t].T + b[t]) / hashing.width).astype(np.int64))
        scored += [np.isin(codes, neighbours.codes(own[i] + neighbours.steps(8)[order[i, : visits[i]]])).mean() for i in range(q.sum())]
    assert np.mean(scored) < 0.1
    frame = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(frame, F.col("id") % 20 == 0, hashing=hashing).toPandas()
    hits = 0
    for i in ids[q]:
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(out[out["query_id"] == i]["vec_id"]))
    assert hits >= 0.9 * 20 * q.sum()


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 0.0]), (8, []), (20, [0.0, 3.0]), (20, [0.0, 3.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = neighbours.nearest(frame, F.col("id") % 20 == 0, hashing=neighbours.Hashing(success=1.0))
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 2.0), (2, 2.0), (20, 0.0)], 20: [(0, 0.0), (1, 0.0), (2, 0.0)]}
    assert neighbours.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_one_bucket_for_all_and_several_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(100, 8))])
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(frame, F.col("id") % 20 == 0, k=5, hashing=neighbours.Hashing(success=1.0), part_rows=64, part_queries=7).toPandas()
    for q in range(0, 400, 20):
        scores = np.array([float(np.einsum("i,i->", a, x[q])) for a in x])
        scores[q] = -np.inf
        want = np.lexsort((np.arange(400), -np.round(scores, 9)))[:5]
        assert out[out["query_id"] == q].sort_values("rank")["vec_id"].tolist() == want.tolist()


def test_few_candidates_and_hot_buckets_with_the_usual_hashing(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-5.0, 0.5]), (4, [0.0, -4.0]), (20, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(frame, F.col("id") % 20 == 0).collect()}
    assert got == {(q, i) for q in (0, 20) for i, _ in rows if i != q}
    # A hot bucket near the query takes all of the estimated success, though it has fewer than k vectors.
    rng = np.random.default_rng(5)
    x = np.vstack([np.tile(rng.normal(size=8), (15, 1)), rng.normal(size=(100, 8)) * 3])
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for rows in (64, 16_384):
        out = neighbours.nearest(frame, F.col("id") % 20 == 0, part_rows=rows).groupBy("query_id").count().collect()
        assert sorted(map(tuple, out)) == [(q, 20) for q in range(0, 115, 20)]


def test_one_bucket_for_all_with_the_usual_hashing(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(100, 8))])
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(frame, F.col("id") % 20 == 0, k=5, part_rows=64, part_queries=7).groupBy("query_id").count().collect()
    assert sorted(map(tuple, out)) == [(q, 5) for q in range(0, 400, 20)]


# --- the similarity join ----------------------------------------------------------------------


def shingles(text, n):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(docs, n, percent):
    """docs: (id, text); least id of each row's component, by all pairs."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d if d is not None else -1), len(s), (least[find(i)] if d is not None else -1)) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def awkward_corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(12))
    docs = []
    for _ in range(12):  # families of near copies, chains of copies of copies, and passages that all share
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        now = list(words)
        for _ in range(rng.randint(1, 14)):
            base = now if rng.random() < 0.5 else words
            now = list(base)
            for _ in range(rng.randint(0, 3)):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            docs.append(" ".join(now) + (" " + shared if rng.random() < 0.3 else ""))
    docs += [None, "", " \t\n", "One", "one", "one two", "One  TWO", "one two three", "É x y z", "é x y z"]
    docs += [docs[0]] * 3
    rng.shuffle(docs)
    return [*enumerate(docs), (0, docs[0]), (1, "another text for an id that is there"), (None, docs[2])]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 70), (4, 1, 100)])
def test_components_equal_all_pairs(spark, seed, n, percent):
    docs = awkward_corpus(seed)
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, node string, n int").repartition(3)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_shingles"], (r["component_id"] if r["component_id"] is not None else -1)) for r in jaccard.link(frame, n, percent).collect())
    assert got == brute_components(docs, n, percent)


def test_join_of_nothing(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string"), 3, 90).count() == 0
    rows = jaccard.link(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), 3, 90).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_group_stays(spark):
    """Ids may repeat with other texts; a row without id is a copy like any other; names of columns don't matter."""
    text, other = " ".join(f"w{k}" for k in range(60)), "quite another text of some words here"
    rows = [(3, text), (1, text + " end"), (2, other), (2, other), (4, None), (5, ""), (None, text), (1, "of the same id but with a text of its own"), (None, "no id and no copy of any"), (5, "")]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, number string, _rows int, key int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), (r["text"] or "")[:8]) for r in kept.collect()) == [(0, "no id an"), (1, "of the s"), (1, text[:8]), (2, "quite an"), (4, ""), (5, ""), (5, "")]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [3, 5])
def test_partitions_of_short_texts(words):
    """A part may hold fewer words in all than an n-gram has."""
    for n in range(words + 2):
        owner, _ = jaccard.shingle_sets(pa.array([" ".join("abcdefg"[:n])]), words)
        assert len(owner) == (0 if n == 0 else max(1, n - words + 1))
    assert len(jaccard.shingle_sets(pa.array([None, "a", "b c"]), words)[0]) == 2


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_polynomials_confuse():
    """Thue-Morse words and their complements have equal polynomials modulo powers of two."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    owner, grams = jaccard.shingle_sets(pa.array([word, other, word.upper()]), 3)
    assert owner.tolist() == [0, 1, 2] and grams[0] != grams[1] and grams[0] == grams[2]


def test_little_of_a_join_stays_on_the_shared_disk(spark):
    """Texts that share passages, none of them linked: their prefixes' n-grams are kept compressed, and go at the end."""
    rng = random.Random(6)
    passages = [" ".join(f"w{rng.randrange(9999)}" for _ in range(12)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(passages) for _ in range(12))) for i in range(3000)]
    shared = Path(jaccard.durable(spark.range(1)).sparkSession.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before = size()
    assert jaccard.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 3, 90).count() == len(docs)
    assert size() - before < 0.35 * sum(len(t) for _, t in docs)
    assert not list(shared.glob("links-*"))


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Pairs measured stay in proportion to the texts, and components equal those of all pairs."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 700):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6])):
            words[rng.randrange(150)] = f"x{rng.randrange(2000)}"
        docs.append((i, " ".join(words)))
    made = []
    keep = jaccard.durable
    monkeypatch.setattr(jaccard, "durable", lambda df: made.append(keep(df)) or made[-1])
    got = sorted(tuple(r) for r in jaccard.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 3, 90).collect())
    assert got == brute_components(docs, 3, 90)
    assert sum(x.count() for x in made if x.columns == ["a", "b", "n_a", "n_b"]) < 3 * len(docs)


def test_fragments_cut_the_order_evenly():
    rng = np.random.default_rng(1)
    ranks = np.round(1000 * np.log2(1 + rng.integers(0, 50, 1 << jaccard.BUCKET_BITS))).astype(np.uint16)
    grams = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    parts = jaccard.fragment_of(grams, ranks, jaccard.cuts_of(ranks))
    where = ranks[jaccard.bucket_of(grams)].astype(np.int64)
    assert set(parts) == set(range(jaccard.FRAGMENTS)) and all(where[parts == k].max() <= where[parts == k + 1].min() for k in range(jaccard.FRAGMENTS - 1))
    weight = np.bincount(parts, weights=np.exp2(where / 1000) - 1)
    assert weight.max() < 1.1 * weight.min()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(k, 7) for k in range(200, 260)] + [(5, 5), (8, 9), (9, 8), (9, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(200, 260)} == {7} and got[9] == 8 and 5 not in got


# --- the pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").set_index("doc_id")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "personal_data", "packing"]
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf_dir)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = set(at.toPandas()["doc_id"])
    poor = set(labels.index[labels["quality"] == 0])
    clean = set(labels.index[(labels["quality"] == 1) & (labels["toxic"] == 0)])
    assert len(kept["quality"] & poor) <= 0.05 * len(poor)
    assert len(clean - kept["quality"]) <= 0.03 * len(clean)
    assert kept["packing"] == kept["personal_data"] == kept["near_copies"] < kept["quality"]
    masked = spark.read.parquet(str(tmp_path / "personal_data")).toPandas()
    assert not masked["text"].str.contains(r"[a-z0-9.]+@mail\d\.example\.com", regex=True).any()
    assert (masked["n_chars"] == masked["text"].str.len()).all()


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y z a b", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert sorted(str(r["doc_id"]) for r in out.select("doc_id").distinct().collect()) == (["1", "2", "None"] if name == "some" else [])


# --- against SQL and slow forms ---------------------------------------------------------------


def test_host_path_and_rule_equal_sql(spark):
    """What op3 tells besides the learned verdict is SQL, on all rows."""
    import duckdb

    path = "/root/testdata/sf0.01/pages.parquet"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fits = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(urls.RULES, key=lambda x: -len(x[0])))
    told = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES)
    sql = f"""WITH h AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM '{path}'),
    r AS (SELECT *, CASE {fits} ELSE NULL END AS rule FROM h) SELECT page_id, host, path, rule, CASE rule {told} ELSE NULL END FROM r"""
    got = registry.op3_url_filter(spark, "/root/testdata/sf0.01").select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict"))).collect()
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got), key=key) == sorted(duckdb.sql(sql).fetchall(), key=key)


def test_no_url_tells_its_own_label(spark):
    """A domain that was seen once has the rate of one that wasn't, in training as in scoring."""
    rows = spark.createDataFrame([("http://a.com/1", "a.com", 1.0), ("http://b.com/1", "b.com", 0.0), ("http://b.com/1", "b.com", 0.0), ("http://c.com/1", "c.com", None), *((f"http://d.com/{k}", "d.com", 1.0) for k in range(40))], "url string, _domain string, _label double")
    told = {(r["url"], r["domain_rate"], r["domain_seen"]) for r in urls._statistics(rows, F.col("_label").isNotNull(), "_domain", "domain").collect()}
    assert {("http://a.com/1", 0.5, 0.0), ("http://b.com/1", 0.5, 0.0), ("http://c.com/1", 0.5, 0.0)} <= told
    assert all(rate > 0.9 for url, rate, _ in told if "d.com" in url)


def test_additive_scores_equal_a_row_by_row_sum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=10)
    slow = []
    for row in x:
        total = model.start
        for cuts, table, value in zip(model.cuts, model.tables, row, strict=True):
            total += table[sum(c <= value for c in cuts)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(c <= row[a] for c in model.coarse[a])][sum(c <= row[b] for c in model.coarse[b])]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.score(x), slow) and len(model.pairs) > 0
