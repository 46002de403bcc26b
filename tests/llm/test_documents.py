"""Operators on documents, against plain re-statements, with nulls, empty and long texts, repeats, empty tables and clashing columns."""
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import public_tokenizers
from vecloom.llm import bpe, chunks, jaccard_join, licences, lm, mixing, quality, queries, secret_scan, sharding

from .cases import WORD, components, documents, repeats, secrets, shingles, texts, unigram_scores, words


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


# 1 n-gram Jaccard join


def test_jaccard_join(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts())}
    want = components(sets)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert got[1][1] == got[2][1] == got[4][1] == 0 and got[5] == (0, 5) and got[10][1] == 9


def test_jaccard_join_empty_and_repeated(spark, none):
    assert jaccard_join.join(none).count() == 0
    twice = documents(spark, [(3, texts()[0]), (3, texts()[0]), (3, texts()[12]), (4, texts()[0])])
    got = [tuple(r) for r in jaccard_join.join(twice).collect()]
    assert sorted((i, n) for i, n, _ in got) == [(3, len(shingles(texts()[0])))] * 3 + [(4, len(shingles(texts()[0])))] and {c for _, _, c in got} == {3}
    assert jaccard_join.keep_one(documents(spark)).count() == len(set(components({i: shingles(t) for i, t in enumerate(texts())}).values()))


@pytest.mark.parametrize("part", [2_000_000, 3_000])
def test_jaccard_join_random_groups(spark, monkeypatch, part):
    """Chains of near copies, a passage that all share, and blocks that are split into parts."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    rng, rows = random.Random(5), []
    shared = [f"s{i}" for i in range(60)]
    for g in range(12):
        w = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 30, 120]))] + shared
        for _ in range(rng.choice([1, 2, 9])):
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
            if rng.random() < 0.4:
                w = list(w)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(documents(spark, rows)).collect()}
    assert got == components({i: shingles(t) for i, t in rows})


def test_search_in_two_parts_finds_pairs_between_them():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.sort(np.r_[base[5 * i :], np.arange(i, dtype=np.uint64)]) for i in range(6)]
    assert len(set(jaccard_join.Search(sets).run().tolist())) == 1
    assert len(set(jaccard_join.Search(sets, sides=np.zeros(6, int)).run().tolist())) == 6
    assert len(set(jaccard_join.Search(sets, sides=np.arange(6) % 2).run().tolist())) == 1


def test_heap_and_sorted_merge_agree(monkeypatch):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, 60)) for _ in range(60)]
    one = jaccard_join.Search(sets, 55).run()
    monkeypatch.setattr(jaccard_join, "HEAP", 0)
    two = jaccard_join.Search(sets, 55).run()
    group = lambda c: {tuple(np.flatnonzero(c == k)) for k in set(c.tolist())}
    want = components({i: set(s.tolist()) for i, s in enumerate(sets)}, 55)
    assert group(one) == group(two) == group(np.array([want[i] for i in range(60)]))


# 2 byte-level BPE


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_bpe_round_trip(docs, reference):
    rows = bpe.decode(bpe.encode(docs)).select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == len(texts())
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "")


def test_bpe_random_texts_and_windows(reference, monkeypatch):
    rng = random.Random(3)
    kinds = ["abcdefghij", "aab", " \n\t", "éüß", "0123456789", ".,;:!?'", "日本語中文", "😀👍🏽", "\u2003\u0301", "<|endoftext|>"]
    for window in (bpe.WINDOW, 7):
        monkeypatch.setattr(bpe, "WINDOW", window)
        for _ in range(300):
            s = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(90)))
            assert bpe.encode_text(s) == reference.encode_ordinary(s)


def test_bpe_states_may_be_dropped(reference, monkeypatch):
    for name, n in (("MAX_STATES", 50), ("MAX_PAIRS", 20), ("SLICE", 16), ("WORDS", 3), ("LONG", 9)):
        monkeypatch.setattr(bpe, name, n)
    bpe.encoder.cache_clear()
    for t in (texts()[0], texts()[14], "antidisestablishmentarianism" * 9):
        assert bpe.encode_text(t) == reference.encode_ordinary(t)
    bpe.encoder.cache_clear()


def test_decoder_streams_broken_characters():
    d = bpe.decoder(None)
    by = {b: i for i, b in d.text_of.items()}
    thumb = [by[bytes([b])] for b in "👍".encode()]
    assert "".join(d.decode(thumb)) == "👍" and "".join(d.decode(thumb[:2])) == "\ufffd"
    assert "".join(d.decode([*thumb[:2], by[b"a"]])) == "\ufffda"


def test_bpe_emits_while_it_reads():
    """All but a bounded rest of a long word is out before its end."""
    t, word = bpe.encoder(None), ("antidisestablishmentarianism" * 40).encode()
    pieces = list(t.run(word))
    assert len(pieces) == 2 and len(pieces[-1]) < 40 < len(pieces[0])


def test_bpe_pattern_for_near_characters():
    rng = random.Random(5)
    every, near, far = bpe.patterns(public_tokenizers.PATTERN)
    for _ in range(400):
        s = "".join(rng.choice([chr(rng.randrange(0x250)), rng.choice(" 'stremvld\n\x1c\x85\xa0")]) for _ in range(rng.randrange(60)))
        assert not far.search(s) and near.findall(s) == every.findall(s)


def test_bpe_query_against_library(spark, reference, tmp_path):
    """The registered query, with null, empty and repeated rows and columns that clash."""
    path = str(tmp_path)
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(3, texts()[3], 1), (None, "null id", 2), (90, None, 3), (91, "", 4), (92, "x" * 30_000 + " ünïcode " * 9_000, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, `ids` long").repartition(3).write.parquet(f"{path}/documents.parquet")

    def want(doc_id, text):
        ids = reference.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op2_byte_bpe(spark, path).collect()]
    assert sorted(got, key=str) == sorted((want(i, t) for i, t, _ in rows), key=str)


def test_bpe_empty(none):
    assert bpe.decode(bpe.encode(none)).count() == 0


# 3 licences


def test_licences(spark, none):
    mit = licences.KNOWN[0][1]
    rows = [mit, "Copyright (c) 2020 Jane Doe\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sublicence").replace("\n", "\r\n"), mit + " more", "prose\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0.", None, "", "released UNDER the mit license", "license"]
    got = [(r["licence"], r["notices"]) for r in licences.scan(documents(spark, list(enumerate(rows)))).orderBy("doc_id").collect()]
    assert got == [("MIT", ""), ("MIT", ""), ("MIT", ""), (None, ""), (None, "CC-BY-NC-4.0,MIT"), (None, ""), (None, ""), ("MIT", "MIT"), (None, "")]
    assert licences.scan(none).count() == 0 and licences.scan(documents(spark), texts=()).filter("licence is not null").count() == 0


# 6 sharding


def test_lookup_table_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(7))
    full, less = sharding.fill(names, 1009), sharding.fill(names[:-1], 1009)
    n = Counter(full)
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == 1009
    moved = sum(a != b for a, b in zip(full, less) if a != 6)
    assert moved < 0.15 * 1009
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)
    # by definition: in turn, each shard takes the first free slot of its permutation
    order, free = {i: [(sharding._hash(s, "offset") + k * (sharding._hash(s, "skip") % 1008 + 1)) % 1009 for k in range(1009)] for i, s in enumerate(names)}, [-1] * 1009
    turn = 0
    while -1 in free:
        i = turn % 7
        free[next(s for s in order[i] if free[s] < 0)] = i
        turn += 1
    assert tuple(free) == full


def test_placement(spark, docs, none):
    rows = sharding.place(docs, "doc_id").collect()
    own = sharding.fill(sharding.SHARDS)
    assert len(rows) == len(texts())
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[own[slot]])
    assert sharding.place(none, "doc_id").count() == 0
    nulls = sharding.place(spark.createDataFrame([(None,), ("",)], "key string"), "key").collect()
    assert nulls[0]["shard"] == nulls[1]["shard"] is not None
    assert sharding.place(docs, "doc_id", ()).filter("shard is not null").count() == 0


# 7 language model


def test_lm(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 2_000)
    monkeypatch.setattr(chunks, "RANGE", 500)
    rows = [*enumerate(texts()), *[(100 + i, " ".join(random.Random(i).choices(PROSE_WORDS, k=60))) for i in range(60)]]
    got = {r["doc_id"]: r for r in lm.score(documents(spark, rows)).collect()}
    for i, (held, n, known, total, base) in unigram_scores(rows).items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    assert lm.score(none).count() == 0


PROSE_WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def test_lm_predicts_held_out_texts_better(spark, data):
    rows = lm.score(spark.read.parquet(f"{data}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_is_a_distribution(spark):
    """Over a vocabulary and one unknown word the probabilities after a word sum to 1."""
    train = [(i, "a b a c") for i in range(20) if lm.fold(i) != lm.HELD_OUT]
    test = [i for i in range(1000, 1200) if lm.fold(i) == lm.HELD_OUT][:5]
    asked = ["a a", "a b", "a c", "a zzz", "a"]
    got = {r["doc_id"]: r["score"] for r in lm.score(documents(spark, [*train, *zip(test, asked)])).collect()}
    # P(a) * P(x | a) * P(end | x) is not comparable, so use texts of one word: P(x | start) * P(end | x)
    assert got[test[1]] > got[test[3]] and all(v < 0 for v in got.values())


def test_em_prefers_the_better_order():
    w = lm.learn([(3, 10_000 + 40, 10_000 + 4, 90), (3, 0, 10_000 + 4, 10)])[3]
    assert w[0] > 0.8 and abs(sum(w) - 1) < 1e-9


# 8 mixing


def test_mixing(docs, none):
    rows = mixing.plan(docs).select("doc_id", "source", "_size", "_mix.*", "_copies").collect()
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts())}
    assert {r["doc_id"]: r["_size"] for r in rows} == size
    per = Counter()
    for i in size:
        per[[None, "b", "a", "é"][i % 4]] += size[i]
    weight = dict(zip(["a", "b", "é", None], (5.0, 2.0, 1.0, 5.0)))
    target, open_, left = {}, set(per), 1.5 * sum(per.values())
    while open_:  # by definition: cut what is above, share the excess among the others
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * per[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * per[s]
            left -= target[s]
        open_ -= full
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == per[r["source"]] and math.floor(r["rate"]) <= r["_copies"] <= math.ceil(r["rate"]) <= 2
    again = {r["doc_id"]: r["_copies"] for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["_copies"] for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(again.values())
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_nears_targets_and_salts(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    salted = {r["doc_id"]: r["_copies"] for r in mixing.plan(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 100)
    planned = mixing.plan(docs)
    assert salted == {r["doc_id"]: r["_copies"] for r in planned.collect()}
    for r in planned.groupBy("source").agg(F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.first("_mix.target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.1 * r["target"]


def test_mixing_of_texts_without_words(spark):
    rows = mixing.plan(documents(spark, [(0, None), (1, ""), (2, " ")])).collect()
    assert [(r["_size"], r["_copies"]) for r in rows] == [(0, 0)] * 3


# 9 secrets


def test_secret_patterns(docs, none):
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs).select("doc_id", "_base", "_spans").collect()}
    for i, t in enumerate(texts()):
        assert sorted(tuple(s) for s in rows[i]["_base"]) == secrets(t), t
    found = [(t[s["start"] : s["stop"]]) for i, t in enumerate(texts()) for s in rows[i]["_spans"] if s["kind"] == 3]
    assert "zq8Kf7LpX2vN9tRw4YsB1mDg6HjC3eAu" in found and not [f for f in found if len(set(f)) == 1 or "identifier" in f]
    assert secret_scan.scan(none).count() == 0


def test_secret_models_tell_classes_apart(spark):
    tokens = secret_scan.default_samples(spark, 400).filter(F.length("token") >= secret_scan.MIN_TOKEN)
    hits = secret_scan.scan(tokens.select(F.col("token").alias("text"), "secret")).select("secret", F.exists("_spans", lambda s: (s["kind"] == 3) | F.col("secret")).alias("hit")).groupBy("secret", "hit").count().collect()
    n = {(r["secret"], r["hit"]): r["count"] for r in hits}
    assert n[True, True] > 0.97 * (n[True, True] + n.get((True, False), 0)) and n.get((False, True), 0) < 0.03 * n[False, False]


def test_redaction(docs):
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert got[18] == "[secret]' token:short [secret] [secret]" and got[5] is None and got[0] == texts()[0]
    assert got[19] == "emoji 👍🏽 [secret] [secret]"
    assert secret_scan.redact(docs).columns == docs.columns


# 10 quality


def test_quality(docs, none):
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    pack = zstandard.ZstdCompressor(level=quality.LEVEL)
    for i, t in enumerate(texts()):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        r = rows[i]
        assert [r[c] for c in quality.COUNTS] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(t)], t[:50]
        assert r["base_failed"] == (len(w) < 50 or 100 * repeats(t) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
        assert t == "" or math.isclose(r["ratio"], len(t.encode()) / len(pack.compress(t.encode())))
    assert rows[0]["kept"] and not rows[17]["kept"] and not rows[16]["kept"]
    assert quality.judge(none).count() == 0 and quality.keep(docs).columns == docs.columns


def test_quality_bands_reject_noise_and_repetition():
    pack = zstandard.ZstdCompressor(level=3)
    noise = np.random.default_rng(1).bytes(9000)
    for raw in (noise, noise.hex().encode()[:100] * 200, b"word " * 4000):
        assert not quality.in_bands(raw, *quality.ratios(raw, pack))
    half = b" ".join(b"w%d" % i for i in np.random.default_rng(2).integers(0, 3000, 4000)) + noise * 4  # a good beginning does not save a bad rest
    assert not quality.in_bands(half, *quality.ratios(half, pack))


def test_word_hashes_agree_with_words():
    h, n = chunks.word_hashes(pa.array(texts()))
    assert n.tolist() == [len(words(t)) for t in texts()]
    flat = [w for t in texts() for w in words(t)]
    assert len({(w, x) for w, x in zip(flat, h.tolist())}) == len(set(flat))
