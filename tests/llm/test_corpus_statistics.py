"""Phrases, resampling and similarity digests against SQL, brute force and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import improbable, phrases, registry, resampling
from tests.conftest import TABLES

duckdb = pytest.importorskip("duckdb")
SCHEMA = "doc_id long, text string, lang string, rank long, word string, id string, bucket string"


def frame(spark, rows):
    """Documents with columns whose names operators use as well."""
    return spark.createDataFrame([(i, t, lang, 1, "w", "i", "b") for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = registry.QUERIES[name](spark, sf_dir)
    cursor = db.execute(registry.ORACLES[name])
    assert [d[0] for d in cursor.description] == found.columns
    rows = [tuple(r) for r in found.collect()]
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, cursor.fetchall()))


# --- phrases ----------------------------------------------------------------------------------


def test_levels_of_phrases_are_no_checkpoints(spark, monkeypatch):
    """Places of phrases are kept compressed, pairs of words in turns, and nothing of it stays."""
    docs = frame(spark, [(i, "one two three four. five six", "en") for i in range(8)])
    made, keep = [], phrases.durable
    monkeypatch.setattr(phrases, "durable", lambda df: made.append(df.columns) or keep(df))
    found = sorted((r["phrase"], r["a"]) for r in phrases.mine(docs, least=8).collect())
    assert found == [("five six", 8), ("one two three four", 8)]
    assert made and not any("place" in columns for columns in made)


def test_small_partitions_fill_shards_together(spark, sf_dir, monkeypatch):
    """Shards hold more words the fewer tasks make them, and so fewer pairs are shuffled."""
    made, shards = [], phrases._shards
    monkeypatch.setattr(phrases, "_shards", lambda docs, size: made.append(docs.rdd.getNumPartitions()) or shards(docs, size))
    phrases.mine(registry.table(spark, sf_dir, "documents").repartition(64), least=200).collect()
    assert made == [min(64, 3 * spark.sparkContext.defaultParallelism)]


def test_turns_share_out_the_extensions():
    row = np.r_[0, np.random.default_rng(5).integers(0, 9, 400), 0].astype(np.int32)
    forward, backward = (phrases.from_planes(pa.py_buffer(phrases.planes(x))) for x in phrases.transforms(row))
    wide = np.array([0, 255, 256, 70_000, 1 << 24], np.int32)
    assert all((phrases.from_planes(pa.py_buffer(phrases.planes(wide[:k]))) == wide[:k]).all() for k in range(1, 6))
    counts = np.bincount(row)
    begins, phrase = np.cumsum(counts)[:-1], np.arange(8) + (5 << 32)
    whole = phrases.extend(backward, begins, begins, counts[1:], phrase)
    parts = [phrases.extend(backward, begins, begins, counts[1:], phrase, turn, 3) for turn in range(3)]
    assert all(0 < len(p["n"]) < len(whole["n"]) for p in parts)
    assert sorted(zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in whole), strict=True)) == sorted(zip(*(x.tolist() for x in whole.values()), strict=True))


def counted(rows, least):
    """(lang, phrase): (a, l, r, n, score), by the definition."""
    counts, sizes = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    counts[lang, tuple(words[k : k + size])] += 1
    frequent = {k: f for k, f in counts.items() if f >= least}
    within = {(lang, part, f) for (lang, p), f in frequent.items() for part in (p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p))}
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and (lang, p, a) not in within:
            score, k = min((1000 * a * sizes[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, counts[lang, p[:k]], counts[lang, p[k:]], sizes[lang], score)
    return out


@pytest.mark.parametrize("shard_words", [20, 150, 1 << 20])
def test_phrases_equal_a_count_by_definition(spark, shard_words):
    rng = np.random.default_rng(3)
    vocabulary = ["To", "be", "or", "not", "\u00e9t\u00e9", "x\u00a0y", "B\u00c9", "\u65e5\u672c"]
    rows = [(k, "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "!?"], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02]) for w in rng.choice(vocabulary, rng.integers(1, 60))), rng.choice(["en", "de", None])) for k in range(80)]
    rows += [(100 + k, "one same passage of seven words here", "en") for k in range(9)] + [(200, None, "en"), (201, "", None), (202, " .\t; ", "de"), (None, "To be or not To be", "en"), (None, "To be or not To be", "en")]
    rows += [(300, "again " * 40, "en"), (301, "w" * 5000 + " " + "w" * 5000, "en")]
    for least in (3, 9):
        got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.mine(frame(spark, rows), least=least, shard_words=shard_words).collect()}
        assert got == counted(rows, least) and len(got) > 20


def test_phrases_rank_ties_by_bytes_and_keep_the_best(spark):
    rows = [(k, "b a. c \u00e9. B A! a z", "en") for k in range(4)]
    got = [(r["rank"], r["phrase"]) for r in phrases.mine(frame(spark, rows), least=2, most=3).orderBy("rank").collect()]
    assert got == [(1, "a z"), (2, "c \u00e9"), (3, "b a")] or [p for _, p in got] == [p for _, p in sorted(((-v[4], -v[0], k[1].encode()), k[1]) for k, v in counted(rows, 2).items())][:3]
    assert phrases.mine(frame(spark, []), least=1).collect() == []
    assert phrases.mine(frame(spark, [(1, None, None), (2, " . ", "en")]), least=1).collect() == []


def test_phrases_leave_nothing_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    phrases.mine(frame(spark, [(1, "a b a b", "en")]), least=2).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_indexes_are_never_shuffled(spark, sf_dir, monkeypatch):
    plans = []
    kept = phrases._frequent
    monkeypatch.setattr(phrases, "_frequent", lambda found, keys, least: plans.append(found._jdf.queryExecution().executedPlan().toString()) or kept(found, keys, least))
    phrases.mine(registry.table(spark, sf_dir, "documents").repartition(8), least=20).collect()
    for plan in plans[1:]:
        shuffled = [x for x in plan.splitlines() if "Exchange" in x]
        assert len(shuffled) == 1 and "place" in plan  # what is frequent goes to the shards; the bucketed table stays


# --- resampling -------------------------------------------------------------------------------

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=2):
    words = WORDS.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return words, [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_crcs_from_running_registers(longest):
    texts = ["Hello, World 42! h\u00e9\u00e9 w\u00f6rld's", "", None, "a", "  ..  ", "x" * 2000 + " yy zz " + "q" * 700, "\u65e5\u672c go", "b" * 512 + " " + "c" * 511, "Z" * 70_000 + " z"]
    data, offsets = resampling.utf8_bytes(pa.array(texts))
    who, crcs, words = resampling.ngram_crcs(data, offsets, longest)
    assert sorted(zip(who.tolist(), crcs.tolist(), strict=True)) == sorted((k, zlib.crc32(f)) for k, t in enumerate(texts) for f in features(t, longest)[1])
    assert words.tolist() == [len(features(t)[0]) for t in texts]


def test_draw_by_definition_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "Ff"], rng.integers(0, 60))), "en") for k in range(300)]
    rows += [(900 + k, "same text " * 15, "en") for k in range(60)] + [(1000, None, "en"), (1001, "", "en"), (1002, "\u00fc " * 5000, None), (None, "no id " * 20, "en")]
    target = [(1, "aa bb aa bb", "en"), (2, None, "en"), (3, "dd \u00fc", "en")]
    docs = frame(spark, rows)
    got = resampling.draw(resampling.weigh(docs, resampling.gains(resampling.bucket_counts(docs), resampling.bucket_counts(frame(spark, target))))).collect()
    s, t = (collections.Counter(zlib.crc32(f) % 10_000 for _, text, _ in x for f in features(text)[1]) for x in (rows, target))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    expected = []
    for i, text, _ in rows:
        words, f = features(text)
        weight = sum(gain(zlib.crc32(x) % 10_000) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        expected.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    drawn = sorted((x for x in expected if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    ranks = {x: k + 1 for k, x in enumerate(drawn[: 25 * len(drawn) // 100])}
    key = lambda x: repr(x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((*x, ranks.get(x)) for x in expected), key=key)


def test_empty_tables_draw_nothing(spark):
    none = frame(spark, [])
    gains = resampling.gains(resampling.bucket_counts(none), resampling.bucket_counts(none))
    assert {r["gain"] for r in gains.collect()} == {0}
    assert resampling.draw(resampling.weigh(none, gains)).collect() == []


# --- digests ----------------------------------------------------------------------------------


def test_entropy_of_every_window():
    rng = np.random.default_rng(7)
    data = np.concatenate([rng.integers(0, 256, 300), np.full(80, 65), rng.integers(97, 101, 300)]).astype(np.uint8)
    for k, b in enumerate(improbable.entropies(data)):
        counts = np.bincount(data[k : k + improbable.WINDOW])
        p = counts[counts > 0] / improbable.WINDOW
        assert abs(b - min(-(p * np.log2(p)).sum() * improbable.STEPS, improbable.BINS - 1)) <= 1.001
    assert len(improbable.entropies(data[:31])) == 0 and len(improbable.entropies(data[:32])) == 1


def test_selected_windows_by_definition():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 31, 32, 40, 127, 128, 600)] + [b"a" * 300]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ranks = rng.permutation(improbable.BINS).astype(np.int64)
    who, begin, end = improbable._select(data, offsets, ranks)
    got = {k: [(int(b - offsets[k]), int(e - offsets[k])) for w, b, e in zip(who, begin, end, strict=True) if w == k] for k in range(len(texts))}
    for k, t in enumerate(texts):
        bins = improbable.entropies(np.frombuffer(t, np.uint8))
        rank = {i: int(ranks[b]) for i, b in enumerate(bins) if b >= improbable.LEAST * improbable.STEPS}
        votes = collections.Counter()
        for left in range(-31, len(bins)):
            if inside := [i for i in range(max(left, 0), left + 32) if i in rank]:
                votes[min(inside, key=lambda i: (rank[i], i))] += 1
        chosen = [i for i in rank if votes[i] >= improbable.VOTES] or ([min(rank, key=lambda i: (-votes[i], i))] if rank else [])
        spans = {(i, i + 32) for i in chosen}
        if len(t) < improbable.SHORT:
            spans |= {(i, i + 8) for i in range(len(t) - 7)}
        if t and (len(t) < 8 or (not chosen and len(t) >= improbable.SHORT)):
            spans.add((0, len(t)))
        assert got[k] == sorted(spans)


def test_compared_with_the_next_document(spark):
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    same = prose(400)
    rows = [(int(k * 7 - 300), prose(int(rng.integers(20, 300))), "en") for k in range(90)] + [(10_000, same, "en"), (10_001, same, "en"), (10_002, same + " " + prose(5), "en"), (5_000, prose(30_000), "en"), (5_001, "\u65e5\u672c\u8a9e " * 90, "en"), (-9_000, None, "en"), (-9_001, "", "en"), (None, prose(50), "en"), (7_000, "short", "en")]
    docs = frame(spark, rows).repartition(5)
    ranks = improbable.rarity(docs)
    told = {r["doc_id"]: r for r in improbable.compared(docs, ranks).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True, key=lambda r: r[0]) + [r for r in rows if r[0] is None]
    assert len(told) == len(rows)
    own = {r["doc_id"]: r["fingerprint"] for r in improbable.fingerprints(docs, ranks).collect()}
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = told[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == own[i]
        assert r["near_next"] == improbable.likeness(improbable.read(r["fingerprint"]), improbable.read(own[order[(k + 1) % len(order)][0]]))
        assert r["near_edited"] == improbable.likeness(improbable.read(r["fingerprint"]), improbable.read(r["edited_fingerprint"]))
        if len(text) > 200 and i is not None and i not in (10_000, 10_001, 10_002, 5_001):
            assert r["near_edited"] > 0.35 > 0.3 > r["near_next"]
    assert told[10_001]["fingerprint"] == told[10_000]["fingerprint"] and told[10_001]["near_next"] == 1
    assert told[10_002]["near_next"] > 0.9 and told[-9_000]["near_next"] == 1 and told[-9_001]["near_next"] == 0


def test_digests_of_few_and_of_repeated_rows(spark):
    ranks = improbable.rarity(frame(spark, []))
    assert improbable.compared(frame(spark, []), ranks).collect() == []
    lone = improbable.compared(frame(spark, [(4, "just one text", None)]), ranks).collect()
    assert [(r["doc_id"], r["near_next"]) for r in lone] == [(4, 1.0)]
    rows = [(1, "abc", None)] * 3 + [(1, "abd", None), (None, None, None), (None, "x y z", None)]
    assert sorted(r["n_chars"] for r in improbable.compared(frame(spark, rows), ranks).collect()) == [0, 3, 3, 3, 3, 5]
    clashing = frame(spark, rows).withColumnRenamed("word", "Fingerprint")
    assert improbable.fingerprints(clashing, ranks).columns[-1] == "_fingerprint"
