"""The operators of the llm subpackage against brute force, on the small tables and on odd rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyframe.llm import (
    exact_dedup,
    fingerprints,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    ngram_join,
    queries,
    sentencepiece_bpe,
    token_counts,
    warc,
)
from tallyframe.llm.common import components

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, `_uid` long, piece string"
LONG = " ".join(f"w{n % 977}x{n % 13}" for n in range(40_000))
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, "  \n\t ", None, "b"),
    (6, "one", "de", "b"),
    (7, "one", "de", "c"),
    (7, "one", "de", "c"),
    (8, "123 456 !!", None, "c"),
    (9, LONG, "en", "a"),
    (10, LONG + " tail", "en", None),
    (11, "été gross ▁ mark  two   spaces 梦😀 \x00 end\n\nline two three", "fr", "c"),
    (None, "nobody knows this one at all, truly nobody", None, None),
    (None, "nobody knows this one at all, truly nobody", None, None),
    (12, "x" * 3000, "en", "a"),
]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 7, "k", 9, "p") for r in ODD], DDL)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op9_warc", "op11_vector_codes")])
def test_empty_table(spark, none, name, tmp_path):
    none.select("doc_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_of_an_empty_table(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert oracle.compare(oracle.connect(SF), queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name]) is None


# 1


def groups_by_hand(rows, words, percent):
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, s in enumerate(sets):
        common = Counter(m for g in s for m in where[g])
        for m, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[m]) - k):
                parent[root(m)] = root(n)
        for g in s:
            where[g].append(n)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(n)] = min(least.get(root(n), doc_id), doc_id)
    return sorted(((r[0], len(s), least.get(root(n))) for n, (r, s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_shingle_groups(docs, odd, words, percent):
    for frame in (docs, odd):
        got = sorted((tuple(r) for r in ngram_join.shingle_groups(frame, words, percent).collect()), key=str)
        assert got == groups_by_hand(texts(frame), words, percent)


def test_shingle_groups_among_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # so that tiles are cut
    rng = random.Random(5)
    base = [f"v{n}" for n in range(100)]
    rows = []
    for n in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            own[rng.randrange(100)] = f"u{rng.randrange(10**9)}"
        rows.append((n, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.shingle_groups(frame).collect()), key=str)
    assert got == groups_by_hand(rows, 4, 85)


def test_components(spark):
    links = [(n, n + 1) for n in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in range(51)}, 100: 100, 150: 100, 200: 100}


# 2


def test_recurring_templates_are_dropped(spark):
    own = ["".join(chr(97 + (n * k) % 26) for k in range(3, 11)) for n in range(1, 13)]
    rows = [(n, f"{own[n]} {own[n][::-1]} is {own[n]}\nSeen on 2024-01-{n + 1:02d} by our robot\nyes") for n in range(12)]
    rows += [(50, "Seen on 2024-09-09 by our robot\nkept line of this one only"), (51, None), (52, "")]
    got = {r["doc_id"]: r for r in line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3]["text"] == f"{own[3]} {own[3][::-1]} is {own[3]}\nyes" and got[3]["n_dropped"] == 1
    assert got[50]["text"] == "kept line of this one only"
    assert got[51]["text"] is None and got[52]["text"] == "" and got[51]["n_lines"] == 0


def test_templates_generalise():
    a, b, c = "user ann logged in".split(), "user bob logged in".split(), "disk is full now".split()
    t = line_dedup.generalise([tuple(x) for x in (a, b, c)])
    assert t[0] == t[1] == ("user", "<*>", "logged", "in") and t[2] == tuple(c)


def test_lines_by_hand(docs, odd):
    """Equal lines alone: with all words required to be equal a template is a masked line."""
    for frame in (docs, odd):
        got = line_dedup.without_recurring_lines(frame, 3, 1.0).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        seen = defaultdict(set)
        rows = frame.select("doc_id", "text").collect()
        for doc_id, text in rows:
            for line in (text or "").split("\n"):
                words = line_dedup.masked(line)
                if len(words) >= 3:
                    seen[" ".join(words)].add((doc_id, text))
        want = []
        for doc_id, text in rows:
            lines = text.split("\n") if text is not None else []
            keep = [x for x in lines if len(seen[" ".join(line_dedup.masked(x))]) < 3]
            digest = hashlib.sha256("\n".join(keep).encode()).hexdigest()
            want.append((doc_id, len(lines), len(lines) - len(keep), digest))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_equal_lines_of_two_documents(spark, docs, odd):
    """The query's own parameters: lines that are equal in few documents, and short lines."""
    rows = [(n, f"{'abcdefgh'[n] * 9} {n}\nthis very passage is in two documents {n}\nPage one") for n in range(2)]
    rows += [(n, f"Page one\n{'yes' * n} no") for n in range(2, 21)] + [(30, "Page two\n5 1"), (31, "Page two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_recurring_lines(frame).collect()}
    assert got[0] == "aaaaaaaaa 0" and got[2] == "yesyes no" and got[30] == "Page two\n5 1"
    for frame in (docs, odd):
        seen = defaultdict(set)
        held = frame.select("doc_id", "text").collect()
        for doc_id, text in held:
            for line in (text or "").split("\n"):
                seen[line_dedup.equal_form(line)].add((doc_id, text))
        recurs = {f: len(d) >= (2 if len(f.split()) > 2 else 20) for f, d in seen.items() if f}
        assert len(held) < 20 or any(recurs.values())
        for r in line_dedup.without_recurring_lines(frame).collect():
            assert not any(recurs.get(line_dedup.equal_form(x)) for x in (r["text"] or "").split("\n"))


def test_lines_that_only_begin_alike_stay(spark):
    """Leading words and numbers do not make a template; three equal words after them do."""
    own = [f"{chr(97 + n) * 7}" for n in range(24)]
    rows = [
        (n, f"in the end {own[n]} {own[n + 12]}\n{n} 1 {n * 3} {n}\n{n} 2 and {n}\nwritten for you by {own[n]} with much love")
        for n in range(12)
    ]
    got = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(n, t.rsplit("\n", 1)[0]) for n, t in rows]


def test_op2_by_hand(spark, docs, odd):
    """The query's own parameters against brute force over all words, templates and lines."""
    own = ["".join(chr(97 + (n * k) % 26) for k in range(3, 11)) for n in range(40)]
    rows = [(n, f"all of this is {own[n]} written by {own[n][::-1]} for us\nall of this was {own[n]} {'here' if n < 9 else own[n]}") for n in range(40)]
    rows += [(n, f"all of this is {own[n - 70]} written by {own[n - 70] * 2} for them {n}") for n in range(70, 75)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (made, docs, odd):
        held = sorted({tuple(r) for r in frame.select("doc_id", "text").collect()}, key=str)
        equal, word_docs, templates, dropped = defaultdict(set), defaultdict(set), defaultdict(set), set()
        lines = []
        for doc, (_, text) in enumerate(held):
            for number, line in enumerate((text or "").split("\n")):
                words = line_dedup.masked(line)
                leaf = (len(words), *words[:3])
                tail = [(leaf, at, w) for at, w in enumerate(words) if at > 2 and w != "<*>"]
                lines.append((doc, number, line, len(words), tail))
                equal[line_dedup.equal_form(line)].add(doc)
                for place in tail:
                    word_docs[place].add(doc)

        def of(tail):
            for least in [10 * 2**k for k in range(12)]:
                kept = tuple(p for p in tail if len(word_docs[p]) >= least)
                if len(kept) >= 3 and len(kept) >= 0.6 * len(tail):
                    yield kept

        for doc, _, _, _, tail in lines:
            for kept in of(tail):
                templates[kept].add(doc)
        for doc, number, line, n, tail in lines:
            if n and len(equal[line_dedup.equal_form(line)]) >= (20 if n < 3 else 2) or any(len(templates[k]) >= 10 for k in of(tail)):
                dropped.add((doc, number))
        assert frame is odd or dropped
        want = {}
        for doc, (doc_id, text) in enumerate(held):
            parts = text.split("\n") if text is not None else []
            keep = [p for n, p in enumerate(parts) if (doc, n) not in dropped]
            want[doc_id, len(parts), len(parts) - len(keep), None if text is None else "\n".join(keep)] = doc
        got = line_dedup.without_recurring_lines(frame).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert {tuple(r) for r in got} == set(want)


def test_a_hot_leaf_ends(spark):
    """Many lines with one opening that are no template of each other: no task compares all of them."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("once more we "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: F.translate(F.md5((F.col("id") * 17 + k).cast("string")), "0123456789", "ghijklmnop")), " ")).alias("text"),
    )
    assert line_dedup.without_recurring_lines(docs).agg(F.sum("n_dropped")).first()[0] == 0


# 3


@pytest.mark.parametrize("top", [5, 1 << 20, 1 << 62])
def test_elias_fano(top):
    rng = np.random.default_rng(top)
    values = np.unique(rng.integers(0, top, 3000).astype(np.uint64))
    low_bits, n, low, high = lm_scoring.EliasFano.pack(values)
    packed = lm_scoring.EliasFano(low_bits, n, np.frombuffer(low or b"\0", np.uint8), np.frombuffer(high, np.uint8))
    assert (packed.get(np.arange(n)) == values).all()
    asked = np.concatenate([values, rng.integers(0, top + 9, 500).astype(np.uint64)])
    assert (packed.successor(asked) == np.searchsorted(values, asked)).all()


def test_scores(docs, odd):
    for frame in (docs, odd):
        rows = [(i, t.encode().lower().split() + [b"\0end"]) for i, t in texts(frame)]
        held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        c, pairs = Counter(), Counter()
        for (_, w), out in zip(rows, held):
            if not out:
                c.update(w)
                pairs.update(zip([b"\0end", *w], w))
        n, v = sum(c.values()), len(c)
        want = []
        for (i, w), out in zip(rows, held):
            share = {x: (c[x] + 1) / (n + v + 1) for x in w}
            base = sum(math.log10(share[x]) for x in w)
            prior = lm_scoring.PRIOR
            full = sum(math.log10((pairs[a, b] + prior * share[b]) / (c[a] + prior)) for a, b in zip([b"\0end", *w], w))
            want.append((str(i), out and i is not None, len(w), sum(c[x] > 0 for x in w), n, base, full))
        got = [(str(r[0]), *r[1:]) for r in lm_scoring.score(frame).collect()]
        for a, b in zip(sorted(got), sorted(want), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) < 0.02 * b[2]


# 4


def test_fingerprints(docs, odd):
    for frame in (docs, odd):
        rows = sorted(texts(frame), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        got = fingerprints.fingerprints(frame).collect()
        want = Counter()
        for n, (i, text) in enumerate(rows):
            following, half = rows[(n + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            want[i, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        of = defaultdict(set)
        text_of = defaultdict(set)
        for i, text in rows:
            text_of[i].add(text)
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if len(text_of[r["doc_id"]]) == 1:
                of[next(iter(text_of[r["doc_id"]]))].add(r["fingerprint"])
        assert all(len(f) == 1 for f in of.values())


def test_fingerprint_votes(spark):
    frame = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    terms = frame.select(F.explode(fingerprints._terms(F.col("text"), 5))).collect()
    assert len(terms) == 2
    value = fingerprints.simhash(frame, ["doc_id"], "text", "fp").first()["fp"] & (2**64 - 1)
    assert value == (terms[0][0] & terms[1][0]) & (2**64 - 1)  # of two votes both have to be for a bit


def test_within_radius(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(5)]
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp long")
    got = {(r[0], r[1]) for r in fingerprints.within_radius(frame, frame.limit(60), 3).collect()}
    asked = {r[0] for r in frame.limit(60).collect()} - {None}
    assert got == {(a, b) for a in asked for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_op4_reports_near_documents(spark, docs, odd):
    for frame, rows in ((docs, queries.op4_fingerprints(spark, SF).collect()), (odd, fingerprints.with_near(odd).collect())):
        assert Counter(r[:7] for r in rows) == Counter(map(tuple, fingerprints.fingerprints(frame).collect()))
        for n, r in enumerate(rows):
            near = [((int(r["fingerprint"], 16) ^ int(o["fingerprint"], 16)).bit_count(), o) for m, o in enumerate(rows) if m != n]
            near = [(d, o["doc_id"]) for d, o in near if d <= 3]
            assert r["near_documents"] == len(near)
            least = min((d for d, _ in near), default=None)
            ids = [i for d, i in near if d == least and i is not None]
            assert r["nearest_distance"] == least
            small = not ids or r["doc_id"] is None or least or r["doc_id"] > min(ids)
            assert r["nearest_id"] == ((min(ids) if small else max(ids)) if ids else None)
    assert sum(r["near_documents"] for r in rows) > 0


# 5


def test_counts_follow_edits(docs, odd):
    own = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    bits = ["a", " ", "  ", "\n", "'s", "'re", "1", ".", "é", "梦", " the", "x"]
    for _ in range(2000):
        tree = token_counts.TokenTree("".join(rng.choice(bits) for _ in range(rng.randint(0, 300))), own)
        for _ in range(3):
            tree.edit(rng.randint(0, 310), rng.choice([0, 1, 3, 90]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 3))))
            assert tree.total == len(own.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for frame in (docs, odd):
        got = token_counts.count_with_edits(frame, token_counts.revision(), path, public_tokenizers.PATTERN).collect()
        want = [(i, len(own.encoding.encode_ordinary(t))) for i, t in texts(frame)]
        assert sorted(map(str, ((r[0], r[1]) for r in got))) == sorted(map(str, want))


# 6


def test_exact_duplicates(docs, odd):
    for frame in (docs, odd):
        groups = defaultdict(list)
        for i, t in texts(frame):
            groups[t.encode().lower()].append(i)
        want = []
        for t, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            want += [(i, keep, len(ids), i == keep, hashlib.sha256(t).hexdigest()) for i in ids]
        got = [tuple(r) for r in exact_dedup.exact_duplicates(frame).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        left = exact_dedup.deduplicated(frame)
        assert left.columns == frame.columns and left.count() == len(groups)


def test_grace_spills_and_compares_contents():
    records = [(7, f"content {n % 500}".encode() * 20, n, 1, 1) for n in range(3000)]  # one hash for all
    records += [(n % 300 << 56, f"other {n % 300}".encode() * 20, n, 1, 1) for n in range(3000)]
    found = {r[1]: r[2:] for r in exact_dedup.grace(iter(records), 20_000)}
    assert len(found) == 800 and found[b"content 499" * 20] == (2999, 6, 1)


# 7


def test_pieces(docs, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for frame in (docs, odd):
        want = []
        for i, t in texts(frame):
            ids = library.encode(t, add_eos=True)
            digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            want.append((i, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        got = [tuple(r) for r in sentencepiece_bpe.encode_documents(frame, MODEL).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        more = sentencepiece_bpe.encode_documents(frame, MODEL, with_ids=True, with_text=True).collect()
        whole = sorted(str((i, library.encode(t, add_eos=True))) for i, t in texts(frame))
        assert sorted(str((r["doc_id"], r["ids"])) for r in more) == whole
        assert all(hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"] for r in more)


def test_pieces_of_random_text():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentencepiece_bpe.codec(MODEL)
    rng = random.Random(4)
    bits = ["a", "th", "ing", " ", "  ", "\n", "▁", "é", "梦", "😀", "$$", ",", ".", "<unk>", "</s>", "1", "\0", "�"]
    for n in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 200 if n % 50 == 0 else 12)))
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)


# 8


def test_languages(docs, odd):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    labelled = [r for r in docs.filter("lang is not null").collect() if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in labelled) >= 0.95 * len(labelled) > 0
    profiles = language_id.learn(docs)
    found = {r["text"]: r["lang_pred"] for r in language_id.predict(odd, profiles, keep=["text"]).collect()}
    assert {t for t, lang in found.items() if lang == "und"} == {None, "", "  \n\t ", "123 456 !!"}
    kept = language_id.known_language(odd.drop("key"))
    assert kept.columns == odd.drop("key").columns and kept.count() == len(ODD) - 4


# 9


def test_archive(spark, tmp_path):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u1", None), (2, "u2", ""), (4, "u4", "é" * 50_000)]
    rows += [(6, "u\n6", "a\r\n\r\nb"), (7, "u7", "x"), (7, "u7", "x")]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, n long")
    got = warc.archive_pages(pages, str(tmp_path / "a")).collect()
    first = defaultdict(list)
    for p, _, h in rows:
        first[h or ""].append(p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = p != min(first[h or ""])
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((p, len(data), digest, "revisit" if again else "response", min(first[h or ""]) if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "b")).collect() == []
    records = warc.read_archive(spark, str(tmp_path / "a"))
    assert records.filter("record_type = 'revisit'").count() == 3
    assert bytes(records.filter("page_id = 4").first()["payload"]) == ("é" * 50_000).encode()
    # without the index files members are found by unpacking
    for index in (tmp_path / "a").glob("*.cdx"):
        index.rename(index.with_suffix(".gone"))
    records = warc.read_archive(spark, str(tmp_path / "a"))
    assert sorted(map(str, records.select("page_id", "record_type").collect())) == sorted(
        f"Row(page_id={w[0]}, record_type='{w[3]}')" for w in want
    )


def test_pages(spark):
    got = warc.archive_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    want = {
        r["page_id"]: base64.b32encode(hashlib.sha1((r["html"] or "").encode()).digest()).decode()
        for r in spark.read.parquet(f"{SF}/pages.parquet").collect()
    }
    assert {r["page_id"]: r["payload_digest"] for r in got} == want


# 10


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200, 500 / 3, 250 / 3]
    assert mixing.targets([10, 1000, 1000], [5, 2, 1], 3015) == pytest.approx([20, 1996.6666666666667, 998.3333333333334])
    assert mixing.targets([], [], 0) == []


def test_permutation():
    for size in (1, 2, 3, 17, 1000):
        image = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 99))
        assert sorted(image.tolist()) == list(range(size))


def test_shard_counts_do_not_depend_on_the_split():
    slots = [1000, 0, 37, 5000]
    whole = list(mixing.shard_counts(slots, 100, 0, 61))
    assert whole == [r for k in range(0, 61, 7) for r in mixing.shard_counts(slots, 100, k, min(k + 7, 61))]
    assert [sum(r[2] for r in whole if r[1] == s) for s in range(4)] == slots
    assert all(sum(r[2] for r in whole if r[0] == k) == 100 for k in range(60))


def test_mix(docs, odd):
    for frame in (docs, odd):
        rows = mixing.taken_words(frame).collect()
        sizes = sorted((str(i), len(t.encode().split())) for i, t in texts(frame))
        assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sizes
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.taken_words(frame).collect()))
        by = defaultdict(list)
        for r in rows:
            by[r["source_size"], r["target"]].append(r)
        for (size, target), group in by.items():
            n = round(sum(r["size"] for r in group) / size) if size else 1  # sources with the same numbers
            assert abs(sum(r["taken"] for r in group) - n * target) <= 2 * n * mixing.BLOCK


def test_small_sources_reach_their_target(spark):
    """Sources of 1 to 300 words beside a large one; all words of a source are taken as often as its target says."""
    rows = [(n, " ".join(f"w{k}" for k in range(n)), f"s{n}") for n in range(1, 301)]
    rows += [(1000 + n, "large " * 500, "hot") for n in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for options in ({}, {"most_times": 1.3}, {"share": 0.4}):
        by = defaultdict(list)
        for r in mixing.taken_words(frame, **options).collect():
            by[r["source_size"], r["target"]].append(r)
        assert len(by) == 301
        for (_, target), group in by.items():
            assert abs(sum(r["taken"] for r in group) - target) <= 1, options
    for size, block in ((1, 4), (9, 4), (1000, 7), (1024, 128)):
        index = np.arange(-(-size // block))
        n, keys = np.full(len(index), len(index)), np.full(len(index), 5)
        assert (mixing.permuted(mixing.permuted(index, n, keys), n, keys, back=True) == index).all()


def test_mixed_documents(docs, odd):
    for frame in (docs, odd):
        taken = Counter()
        for r in mixing.taken_words(frame).collect():
            taken[r["doc_id"]] += r["taken"]
        mixed = mixing.mixed_documents(frame)
        assert mixed.columns == frame.columns
        got = Counter()
        for i, t in texts(mixed):
            got[i] += len(t.encode().split())
        assert got == +taken


def test_pipeline(spark, docs):
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns
    by_text = {}
    for i, t in texts(docs):
        if any(c.isalpha() for c in t):
            key = t.encode().lower()
            by_text[key] = max(i, by_text.get(key, i))
    left = [(i, t) for i, t in texts(docs) if any(c.isalpha() for c in t) and by_text[t.encode().lower()] == i]
    want = {i for i, n, least in groups_by_hand(left, 5, 80) if least == i}
    assert {r["doc_id"] for r in rows.collect()} == want
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_a_large_group_of_near_copies_is_not_compared_in_all_pairs(spark, monkeypatch):
    base = [f"w{k}" for k in range(200)]
    rows = [(m, " ".join(f"x{m}" if k == m + 20 else w for k, w in enumerate(base))) for m in range(150)]
    hubs, exact, seen = ngram_join._Join.pairs_with, ngram_join._Join.exact, []

    def counted(self, pairs):
        seen.append(pairs.count())
        return exact(self, pairs)

    # without the pairs with hubs, all is left to the comparison across groups
    monkeypatch.setattr(ngram_join._Join, "pairs_with", lambda *args: hubs(*args).limit(0))
    monkeypatch.setattr(ngram_join._Join, "exact", counted)
    found = ngram_join.shingle_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in found.select("component_id").distinct().collect()] == [(0,)]
    assert sum(seen) < 150 * 149 / 4
