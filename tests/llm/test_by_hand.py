"""More of the operators against plain versions, tables with many groups, and columns whose names clash."""

import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import exact_dedup, fingerprints, language_id, line_dedup, lm_scoring, mixing, substring_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


# 8


def grams_of(text):
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        letters = [c for c in word if c.isalpha()]
        if letters:
            found.update(letters)
            padded = ["_", *letters, "_"]
            found.update(a + b for a, b in zip(padded, padded[1:]))
            found.update(a + b + c for a, b, c in zip(padded, padded[1:], padded[2:]))
    return found


def number(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def ranking(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def languages_by_hand(learn, rows, size):
    counts = defaultdict(Counter)
    for text, lang in learn:
        counts[lang] += grams_of(text)
    profiles = {lang: {g: n for n, g in enumerate(ranking(c, size))} for lang, c in counts.items() if c}
    out = []
    for text in rows:
        own = ranking(grams_of(text), size)
        best = ("und", 0.0)
        if own and profiles:
            distance, lang = min(
                (sum(abs(p[g] - n) if g in p else size for n, g in enumerate(own)), lang) for lang, p in profiles.items()
            )
            best = (lang, 1 - distance / (size * len(own)))
        out.append(best)
    return out


@pytest.mark.parametrize("size, at_once", [(400, 128), (30, 2), (5, 1)])
def test_languages_by_hand(spark, docs, monkeypatch, size, at_once):
    monkeypatch.setattr(language_id, "LANGUAGES", at_once)
    rows = docs.collect()
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", language_id.fold("doc_id", 3).alias("f")).collect()}
    learn = [(r["text"], r["lang"]) for r in rows if fold[r["doc_id"]] != 1 and r["lang"] and r["text"] is not None]
    want = languages_by_hand(learn, [r["text"] for r in rows], size)
    got = {r["doc_id"]: r for r in language_id.identify(docs, size).collect()}
    for r, (lang, score) in zip(rows, want):
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score)
        assert got[r["doc_id"]]["held_out"] == (fold[r["doc_id"]] == 1)


def test_six_hundred_languages(spark):
    rows = [(n, " ".join(chr(0x4E00 + n + k) * 2 for k in (0, 700, 1400)), f"l{n:03}") for n in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(frame)
    assert profiles.select("lang").distinct().count() == 600
    found = language_id.predict(frame, profiles, keep=["lang"]).collect()
    assert len(found) == 600 and all(r["lang"] == r["lang_pred"] for r in found)


def test_nothing_learned_rejects_only_texts_without_letters(spark):
    rows = [(1, "some words"), (2, None), (3, ""), (4, "12 34"), (5, "été")]
    frame = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    assert {tuple(r) for r in language_id.known_language(frame).collect()} == {(1, "some words", None), (5, "été", None)}


def test_unknown_languages_are_filled_in(docs):
    kept = {r["doc_id"]: r for r in language_id.known_language(docs).collect()}
    for r in docs.collect():
        if any(c.isalpha() for c in r["text"] or ""):
            out = kept.pop(r["doc_id"])
            assert out["text"] == r["text"] and (out["lang"] == r["lang"] if r["lang"] else out["lang"])
    assert not kept


# 10


def permuted_by_hand(index, size, key):
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask, m64 = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = index >> half, index & mask
        for turn in range(4):
            z = (right + key + turn) * 0x9E3779B97F4A7C15 & m64
            z = (z ^ z >> 29) * 0xBF58476D1CE4E5B9 & m64
            left, right = right, left ^ ((z ^ z >> 32) & mask)
        index = left << half | right
        if index < size:
            return index


def mix_by_hand(rows, places, pieces, block=mixing.BLOCK):
    """rows: doc_id, number of words, source; the words taken per doc_id, and the targets."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    streams = {s: sorted((places[i] % pieces, places[i], i, n) for i, n, of in rows if of == s) for s in names}
    sizes = [sum(d[3] for d in streams[s]) for s in names]
    weights = [mixing.WEIGHTS[n % 3] for n in range(len(names))]
    targets = mixing.targets(sizes, weights, mixing.SHARE * sum(sizes))
    taken, at_slot = Counter(), []
    for number_, (s, size, target) in enumerate(zip(names, sizes, targets)):
        words = [i for _, _, i, n in streams[s] for _ in range(n)]
        left, blocks, slot = min(round(target), 2 * size), -(-size // block), 0
        while left > 0:
            part = words[(b := permuted_by_hand(slot % blocks, blocks, number_ * 1_000_003 + mixing.SEED)) * block : (b + 1) * block]
            taken.update(part[:left])
            left -= len(part[:left])
            slot += 1
        at_slot.append(slot)
    return taken, dict(zip(names, targets)), at_slot


@pytest.mark.parametrize("piece, groups, shard", [(500, 100_000, 4096), (9, 2, 16), (40, 1, 5)])
def test_mix_by_hand(spark, docs, monkeypatch, piece, groups, shard):
    monkeypatch.setattr(mixing, "PIECE", piece)
    monkeypatch.setattr(mixing.slot_table, "__defaults__", (shard, groups))
    place = F.xxhash64(F.col("doc_id"), F.lit(mixing.SEED)).alias("place")
    places = {r["doc_id"]: r["place"] for r in docs.select("doc_id", place).collect()}
    rows = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in docs.collect()]
    taken, targets, slots = mix_by_hand(rows, places, max(1, len(rows) // piece))
    sources = {i: s for i, _, s in rows}
    got = mixing.taken_words(docs).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {i: taken[i] for i, _, _ in rows}
    assert all(r["target"] == pytest.approx(targets[sources[r["doc_id"]]], rel=1e-12) for r in got)
    spans, _, made = mixing.mix(*mixing._numbered(docs))
    assert [r["slots"] for r in made.orderBy("number").collect()] == slots
    table = mixing.slot_table(made).collect()
    shards = Counter(r["shard"] for r in table)
    total = sum(slots)
    assert shards == {k: min(shard, total - k * shard) for k in range(-(-total // shard))}
    assert sorted((r["number"], r["slot"]) for r in table) == [(n, k) for n, m in enumerate(slots) for k in range(m)]
    words = {i: n for i, n, _ in rows}
    assert all(0 <= r["from"] < r["to"] <= words[r["doc_id"]] for r in spans.collect())


def test_more_sources_than_groups(spark):
    rows = spark.range(100_001).selectExpr(
        "id as doc_id", "repeat('w ', cast(id % 3 as int) + 1) as text", "concat('s', lpad(id, 6, '0')) as source"
    )
    got = mixing.taken_words(rows).groupBy("target").agg(F.count("*").alias("n"), F.min("taken"), F.max("taken")).collect()
    assert sum(r["n"] for r in got) == 100_001
    assert all(abs(r["target"] - t) <= 0.5 for r in got for t in r[2:])


def test_targets_of_a_table(spark):
    rng = np.random.default_rng(3)
    for sizes in ([10, 1000, 1000], rng.integers(0, 5000, 60).tolist(), [0, 0], [7]):
        rows = spark.createDataFrame(list(enumerate(map(int, sizes))), "number long, source_size long")
        got = [r["target"] for r in mixing.with_targets(rows, (5, 2, 1), 1.5, 2).orderBy("number").collect()]
        weights = [(5, 2, 1)[n % 3] for n in range(len(sizes))]
        assert got == pytest.approx(mixing.targets(sizes, weights, 1.5 * sum(sizes)))


def test_large_draws_keep_their_sums():
    slots = np.array([3 * 10**9, 0, 5, 10**12, 77, 2 * 10**11], np.int64)
    for n in (0, 1, 10**6, int(slots.sum()) // 2, int(slots.sum()) - 1, int(slots.sum())):
        drawn = mixing._halved(slots, n, 0, 8)
        assert drawn.sum() == n and (drawn >= 0).all() and (drawn <= slots).all()
    half = mixing._halved(slots, int(slots.sum()) // 2, 0, 8)
    assert abs(half[3] - slots[3] / 2) < 5 * np.sqrt(slots[3] / 4) and half[3] != slots[3] // 2


# 4


def simhash_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    votes, n = Counter(), 0
    for at in range(max(len(hashes) - 5, 0) + 1 if hashes else 0):
        seed = 42
        for h in hashes[at : at + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        n += 1
        votes.update(b for b in range(64) if seed >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def test_fingerprints_by_hand(docs):
    rows = sorted(texts(docs), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.with_near(docs).collect()}
    own = {i: simhash_by_hand(t) for i, t in rows}
    for (i, t), (after, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = simhash_by_hand(t[: len(t) - half] + following[:half])
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (f"{own[i]:016x}", f"{edited:016x}")
        assert got[i]["near_edited"] == 1 - (own[i] ^ edited).bit_count() / 64
        assert got[i]["near_next"] == 1 - (own[i] ^ own[after]).bit_count() / 64
        near = sorted(((own[i] ^ f).bit_count(), j) for j, f in own.items() if j != i and (own[i] ^ f).bit_count() <= 3)
        assert got[i]["near_documents"] == len(near)
        assert got[i]["nearest_distance"] == (near[0][0] if near else None)


# 5


def test_edited_counts_by_hand(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in token_counts.count_with_edits(docs, token_counts.revision(), path, public_tokenizers.PATTERN).collect()}
    for r in docs.withColumn("edits", token_counts.revision()).collect():
        text = r["text"] or ""
        assert got[r["doc_id"]]["n_tokens"] == len(plain.encode_ordinary(text))
        for e in r["edits"] or ():
            place, removed = min(e["place"] or 0, len(text)), e["removed"] or 0
            text = text[:place] + (e["added"] or "") + text[place + removed :]
        found = got[r["doc_id"]]
        assert found["edited_chars"] == len(text) and found["edited_tokens"] == len(plain.encode_ordinary(text))
        assert 0 < found["encoded_pieces"] <= 60 or not text


# 9


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    pages = spark.createDataFrame([(n, f"u{n}", f"page {n % 40}" * 30) for n in range(200)], "page_id long, url string, html string")
    path = tmp_path / "a"
    got = warc.archive_pages(pages.repartition(3), str(path)).collect()
    name = next(path.glob("part-*.warc.gz"))
    for suffix in (".warc.gz", ".cdx"):  # what a second attempt of a task would leave behind
        old = name.with_name(name.name.removesuffix(".warc.gz") + suffix)
        old.with_name("part-000000-99999" + suffix).write_bytes(old.read_bytes()[: -20 if suffix == ".warc.gz" else None])
    records = warc.read_archive(spark, str(path))
    assert records.count() == 200 == len(got)
    split = spark.read.format("warc").option("splitBytes", 500).load(str(path))
    assert split.rdd.getNumPartitions() > 10
    assert sorted(map(str, split.collect())) == sorted(map(str, records.collect()))


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "abc"), (2, "abc"), (3, "abcd"), (4, "abcd"), (5, None), (6, "")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages, str(tmp_path / "a"), 4).collect()}
    assert got == {i: ("revisit", 3) if i == 4 else ("response", None) for i, _ in rows}


def test_filters_reach_the_reader_and_payloads_are_left_packed(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x" * 100), (2, "u", "x" * 100)], "page_id long, url string, html string")
    warc.archive_pages(pages, str(tmp_path / "a"))
    records = warc.read_archive(spark, str(tmp_path / "a"), ["page_id", "record_type"]).filter("record_type = 'revisit'")
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan warc" in plan  # nothing is left to filter after the scan
    reader = warc.WarcReader(records.schema, {"path": str(tmp_path / "a")})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")]))
    assert [f.attribute for f in left] == [("payload",)] and reader.wanted == [("record_type", "in", ("revisit",))]
    decoded = []
    indexed = warc._indexed

    def watched(file, members):
        for head, block in indexed(file, members):
            yield head, lambda block=block: decoded.append(1) or block()

    monkeypatch.setattr(warc, "_indexed", watched)
    rows = [r for split in reader.partitions() for batch in reader.read(split) for r in batch.to_pylist()]
    assert rows == [{"page_id": 2, "record_type": "revisit"}] and decoded == []


# columns with the names that the operators use themselves

CLASH = (
    "digest _digest keep sha256 uid _uid spans _spans round found more place share score lang_pred held row k1 k2 kept "
    "_kept component_id number start size source_size target words begin at part before"
).split()


def test_columns_whose_names_clash(spark):
    rows = [(n, f"some words of text {n // 2} and more", "en", "a" if n % 3 else None, n % 2) for n in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = [f"concat('{c}', doc_id) as `{c}`" for c in CLASH]
    frame = frame.selectExpr("*", *own)
    stages = [
        language_id.known_language,
        exact_dedup.deduplicated,
        lambda d: corpus_pipeline.near_copies(spark, d, SF),
        mixing.mixed_documents,
        lambda d: substring_dedup.without_repeats(d, 3),
    ]
    for stage in stages:
        out = stage(frame)
        assert out.columns == frame.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in CLASH)


# pipeline


def test_last_stages_by_hand(spark, docs, monkeypatch):
    _, mixture = corpus_pipeline.STAGES[3]
    _, pieces = corpus_pipeline.STAGES[4]
    place = F.xxhash64(F.col("doc_id"), F.lit(mixing.SEED)).alias("place")
    places = {r["doc_id"]: r["place"] for r in docs.select("doc_id", place).collect()}
    rows = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in docs.collect()]
    taken, _, _ = mix_by_hand(rows, places, 1)
    mixed = mixture(spark, docs, SF)
    got, words = Counter(), {i: Counter((t or "").encode().split()) for i, t in texts(docs)}
    for r in mixed.collect():
        found = Counter(r["text"].encode().split())
        assert not found - words[r["doc_id"]] and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += found.total()
    assert got == +taken
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces(spark, mixed, SF).collect()
    want = Counter((r["doc_id"], tuple(model.encode(r["text"], add_eos=True))) for r in mixed.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == want


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_have_small_batches(spark, docs, number):
    """Of 24 MB of texts in one task, no batch for a Python worker is much above four, whichever stage comes first."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    corpus_pipeline.STAGES[number][1](spark, docs.limit(20), SF)
    long = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("eight by"), 1000).alias("text"))
    found = long.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in found) == 3000 and max(r["size"] for r in found) < 6_000_000
    spark.conf.set(key, "1m")  # what a session says holds
    corpus_pipeline.STAGES[number][1](spark, docs.limit(20), SF)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


# 2


def test_short_lines_with_one_variable_word(spark):
    """Four words of which one is any word recur; with two variable words, or in few documents, they do not."""
    names = ["".join(chr(97 + (n * k) % 26) for k in (3, 7, 11, 17)) + "x" * (n % 5) for n in range(300)]
    rows = [(n, f"user {name} logged in\nin the end {name} {name}ed\nown {name} line") for n, name in enumerate(names)]
    rows += [(300 + n, f"only {name} few documents") for n, name in enumerate(names[:40])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.without_recurring_lines(frame).collect()}
    equal = Counter(line for _, t in rows for line in t.split("\n"))
    for n, text in rows:
        lines = [x for x in text.split("\n") if equal[x] == 1 and not x.startswith("user ")]
        assert got[n]["text"] == "\n".join(lines)


# 3


def test_scores_do_not_depend_on_shards_and_buckets(docs, monkeypatch):
    def scored():
        return {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}

    whole = scored()
    monkeypatch.setattr(lm_scoring, "SHARD_WORDS", 2000)
    monkeypatch.setattr(lm_scoring, "BUCKET_WORDS", 5000)
    cut = scored()
    assert whole.keys() == cut.keys()
    for i, r in whole.items():
        assert r[:5] == cut[i][:5] and r["base_score"] == pytest.approx(cut[i]["base_score"])
        assert abs(r["score"] - cut[i]["score"]) < 0.02 * r["n_tokens"]  # each shard has a codebook of its own


def test_elias_fano_finds_the_last_numbers():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 10, 100, 1000):
        for top in (2, 8, 40, 46, 56, 62):
            for _ in range(8):
                values = np.unique(rng.integers(0, 1 << top, n).astype(np.uint64))
                low_bits, size, low, high = lm_scoring.EliasFano.pack(values)
                found = lm_scoring.EliasFano(low_bits, size, *(np.frombuffer(x or b"\0", np.uint8) for x in (low, high)))
                assert (found.get(np.arange(size)) == values).all()
                asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << top, 50).astype(np.uint64)])
                assert (found.successor(asked) == np.searchsorted(values, asked)).all()


def test_trie_finds_every_bigram():
    rng = np.random.default_rng(2)
    for n in (1, 2, 10, 100, 1000):
        for _ in range(10):
            pairs = np.unique(np.stack([rng.integers(0, 40, n) * 7919 << 18, rng.integers(0, 1 << 36, n)], 1), axis=0)
            context, successor = pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64)
            codes = rng.integers(1, 256, len(pairs)).astype(np.uint8)
            trie = lm_scoring.Trie(lm_scoring.mapped(lm_scoring.Trie.build(context, successor, codes)))
            assert (trie.find(context, successor) == codes).all()
            assert not trie.find(context, successor ^ np.uint64(1 << 35)).any() or n > 100
