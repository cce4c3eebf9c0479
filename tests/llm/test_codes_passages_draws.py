"""Vector codes, recurring passages and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import importance, queries, substring_dedup, vector_codes

SF = "/root/testdata/sf0.001"

# 11


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = -(-max(len(r[1]) for r in kept) // parts)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [[list(cut[n][p]) for n in first] for p in range(parts)]

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(first)), key=lambda e: (gap(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            members = defaultdict(list)
            for v, codes in zip(cut, got):
                members[codes[p]].append(v[p])
            for e, vs in members.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    got = assign()
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    errors = [sum(gap(v[p], books[p][c]) for p, c in enumerate(codes)) for v, codes in zip(cut, got)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return [
        (r[0], "".join(f"{c:02x}" for c in codes), e, by_label[r[2]], digest)
        for r, codes, e in zip(kept, got, errors)
    ]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int")


def same_codes(frame, rows, **how):
    got = vector_codes.encode(frame, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(codes_by_hand(rows, **how), key=str)


def test_codes(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(7)]
    rows = [
        (n, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice([None, 0, 1])) for n in range(400)
    ]
    rows += rows[:60] + [(1000 + n, rows[5][1], 0) for n in range(150)]  # repeated rows and a hot vector
    rng.shuffle(rows)
    same_codes(vectors(spark, rows).repartition(5), rows, entries=12)
    same_codes(vectors(spark, rows), rows, entries=40, rounds=2)


def test_codes_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 32)
    rng = random.Random(12)
    rows = [(n, [rng.choice([0.0, 0.25, 1.0]) for _ in range(4)], n % 3) for n in range(200)]  # ties throughout
    same_codes(vectors(spark, rows).coalesce(2), rows, entries=9)


def test_codes_of_odd_vectors(spark):
    rows = [
        (None, [0.5, -0.5, 0.25, 0.0], None),
        (2, None, 1),
        (3, [0.5, None, 0.0, 0.0], 1),
        (4, [0.5, float("nan"), 0.0, 0.0], 1),
        (5, [float("-inf"), 0.0, 0.0, 0.0], 1),
        (6, [1.0], 1),
        (7, [], 1),
        (7, [0.1, 0.2, 0.3, 0.4, 0.5], None),
        (8, [-0.0, -0.00001, 1e7, -1e7, 0.5], 2),
        (8, [-0.0, -0.00001, 1e7, -1e7, 0.5], 2),
    ]
    same_codes(vectors(spark, rows), rows, entries=3)
    same_codes(vectors(spark, rows), rows)
    assert vector_codes.encode(vectors(spark, rows[1:5])).collect() == []
    assert vector_codes.encode(vectors(spark, rows).limit(0)).collect() == []


def test_codes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    kept = sorted(r for r in rows if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all())
    whole = np.floor(1024 * np.array([r[1] for r in kept], np.float64)).astype(np.int64)
    cut = np.stack(np.split(whole, 4, 1))
    books = cut[:, :256].copy()

    def assign():
        return [((c[:, None] - b[None]) ** 2).sum(2).argmin(1) for c, b in zip(cut, books)]

    for _ in range(4):
        for p, found in enumerate(assign()):
            for e in set(found.tolist()):
                books[p, e] = cut[p][found == e].sum(0) // (found == e).sum()
    found = np.stack(assign(), 1)
    got = queries.op11_vector_codes(spark, SF).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [r[0] for r in kept]
    assert [r["code"] for r in got] == [bytes(c.tolist()).hex() for c in found]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    error = sum(((cut[p] - books[p][found[:, p]]) ** 2).sum(1) for p in range(4))
    assert [r["error"] for r in got] == error.tolist()


def test_tree_gives_whole_subtrees():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (6, 5))
    rows = centres[rng.integers(0, 6, 1000)] + rng.integers(-20, 20, (1000, 5))
    tree = vector_codes.CoverTree.build(rows)
    found, ranges = tree.nearest(centres)
    assert len(ranges) < 30  # whole clusters at once
    assert (found == vector_codes.distances(tree.points, centres).argmin(1)).all()
    inner = np.flatnonzero(tree.last > tree.first)
    assert len(inner)
    for n in inner:  # children are covered, and their own rows stand apart
        kids = np.arange(tree.first[n], tree.last[n])
        assert tree.radius[kids].max() <= tree.radius[n] / 2
        own = tree.points[tree.start[kids]]
        gaps = np.sqrt(vector_codes.distances(own, own)) + np.eye(len(kids)) * 1e9
        assert gaps.min() > tree.radius[n] / 2


# 12

DDL = "doc_id long, text string, k1 string, n_words int, kept string, uid int"


def removed_by_hand(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def same_removals(spark, rows, window):
    frame = spark.createDataFrame([(*r, "k", 1, "t", 2) for r in rows], DDL).repartition(3)
    want = removed_by_hand(rows, window)
    got = substring_dedup.removals(frame, window).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == [w[:4] for w in want]
    spans = [(r["doc_id"], sum(s["last"] - s["first"] + 1 for s in r["spans"])) for r in substring_dedup.repeats(frame, window).collect()]
    assert sorted(spans, key=str) == sorted(((w[0], w[2]) for w in want if w[2]), key=str)
    cut = substring_dedup.without_repeats(frame, window)
    assert cut.columns == frame.columns
    texts = [(r["doc_id"], b" ".join((r["text"] or "").encode().split()).decode()) for r in cut.filter("k1 = 'k' and uid = 2").collect()]
    assert sorted(texts, key=str) == sorted(((w[0], w[4]) for w in want), key=str)


@pytest.mark.parametrize("window, many, frequent, cut", [(35, 1000, 10_000, 1 << 20), (8, 5, 20, 50), (5, 4, 10_000, 30), (2, 3, 50, 9), (1, 4, 9, 9)])
def test_removals(spark, monkeypatch, window, many, frequent, cut):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(substring_dedup, "CUT", cut)
    rng = random.Random(window)
    line = [f"l{n}" for n in range(window + 3)]
    rows = []
    for n in range(80):
        text = [f"{rng.randrange(40 if n % 4 else 3)}" for _ in range(rng.randrange(3 * window))]
        if n % 2:
            at = rng.randrange(len(text) + 1)
            text[at:at] = line[rng.randrange(3) :]
        rows.append((n, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [rows[3]] * 9 + [(200, rows[3][1]), (None, rows[5][1]), (None, None), (201, None), (202, ""), (203, " \t ")]
    rows += [(204, "a " * 300), (205, " ".join(["a", "b"] * 150)), (206, "Straße x \x1f y 梦 " * window)]
    same_removals(spark, rows, window)


def test_nothing_recurs(spark):
    same_removals(spark, [(n, " ".join(f"{n}.{k}" for k in range(50))) for n in range(5)], 35)


def test_a_passage_that_all_share_is_removed(spark):
    passage = " ".join(f"p{n}" for n in range(50))
    rows = [(n, " ".join(f"{n}x{k}" for k in range(n % 40)) + " " + passage + f" end{n}") for n in range(300)]
    frame = spark.createDataFrame([(*r, "k", 1, "t", 2) for r in rows], DDL)
    assert {r["n_removed"] for r in substring_dedup.removals(frame).collect()} == {50}


# 13


def draws_by_hand(docs, target, percent=5, min_words=20, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
        found = [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in found]

    ours = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in ours for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, ours):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = [r for r in rows if r[4] >= min_words]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for place, r in enumerate(able[: len(able) * percent // 100]):
        ranks[r].append(place + 1)
    return [(*r[:4], ranks[r].pop(0) if ranks[r] else None) for r in rows]


def test_draws_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = queries.op13_importance(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(draws_by_hand(docs, target), key=str)
    assert sum(r["rank"] is not None for r in got) > 3


def test_draws_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "CUT", 11)
    rng = random.Random(13)
    words = ["Alpha", "beta", "GAMMA", "été", "梦", "x1", "ẞ", "delta"]
    docs = [(n, rng.choice([" ", ". ", "\n\n"]).join(rng.choices(words, k=rng.randrange(40)))) for n in range(150)]
    docs += [(7, docs[7][1])] * 3 + [(None, "one two " * 15)] * 3 + [(None, None), (300, None), (301, ""), (302, "[]!")]
    docs += [(303, "word " * 5000), (304, "x" * 5000)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int")
    for target in (["alpha beta", None, "été 梦 x1"], []):
        wanted = spark.createDataFrame([(t,) for t in target], "text string")
        got = importance.resample(frame.repartition(4), wanted, percent=30, buckets=97).collect()
        want = draws_by_hand(docs, target, 30, 20, 97)
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert importance.resample(frame.limit(0), frame).collect() == []
    assert importance.resample(frame.filter(F.length("text") < 9), frame).filter("rank is not null").collect() == []
