"""Byte pairs, exact and near duplicates, shards and language spans against brute force and known answers."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from welltide.llm import bpe, exact, langid, shards, simhash
from welltide.llm.components import components

WS = " \t\n\r\x0b\x0c"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a  b\tc", "en", "s", 6), (2, "a b c", "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " ", "en", "s", 1), (6, "\n\n", None, "s", 2),
       (7, "é" * 50 + " ünï", "fr", "s", 54), (8, "x" * 30000 + " y", "en", "s", 30002), (2, "a b c", "en", "s", 5), (None, "a b\nc", "en", None, 5), (9, "12 34 !!", "en", "s", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns named like those the operators make.
    return spark.createDataFrame(ODD, DOCS).withColumns({"key": F.lit("k"), "fp": F.lit(0), "id": F.lit(1), "u": F.lit(2), "size": F.lit(3), "shard": F.lit(9), "_sha": F.lit("x"), "ids": F.lit(1)})


def norm(t):
    out, blank = [], False
    for c in t or "":
        if c in WS:
            if not blank:
                out.append(" ")
            blank = True
        else:
            out.append(c)
            blank = False
    return "".join(out)


def test_exact_groups(spark, odd):
    got = sorted(map(tuple, exact.exact_groups(odd).collect()), key=str)
    by = {}
    for d, t, *_ in ODD:
        by.setdefault(norm(t), []).append(d)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    want = sorted([(d, least[norm(t)], len(by[norm(t)]), d == least[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in ODD], key=str)
    assert got == want
    kept = exact.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    empty = odd.limit(0)
    assert exact.exact_groups(empty).count() == 0 and exact.deduplicated(empty).count() == 0


def test_exact_groups_with_tiny_tries_and_a_hot_text(spark):
    rows = [(i, "same text " * 40 if i % 3 == 0 else f"text {i % 700} " * 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(df, trie_bytes=2000).collect()}
    by = {}
    for d, t in rows:
        by.setdefault(t, []).append(d)
    assert got == {d: (min(by[t]), len(by[t])) for d, t in rows}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=8), st.integers(0, 50)), max_size=60))
def test_patricia_trie(items):
    trie, want = exact.PatriciaTrie(), {}
    for key, i in items:
        trie.insert(key, i, 1, "d")
        a, n = want.get(key, (i, 0))
        want[key] = (min(a, i), n + 1)
    assert {k: (a, n) for k, a, n, _ in trie.take()} == want
    assert list(trie.take()) == []


def test_what_a_trie_counts_covers_its_memory():
    for n, width in ((30_000, 0), (30_000, 8), (2_000, 5000)):  # many short texts, and fewer long ones
        tracemalloc.start()
        trie = exact.PatriciaTrie()
        for i in range(n):
            body = f"{i:06d}".encode() + b"x" * width
            digest = hashlib.sha256(body).hexdigest()
            trie.insert(exact._head(len(body), int(digest[:16], 16)) + body, i, 1, digest)
        used = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert 0.8 * used < trie.held < 2.5 * used, (n, width, used, trie.held)


@pytest.fixture(scope="module")
def enc():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.encoding(f.read(), P.PATTERN)


def test_bpe_round_trip(spark, odd, enc):
    file = P.path("byte_bpe_50k.tiktoken")
    got = sorted(map(tuple, bpe.round_trip(odd, file, P.PATTERN).collect()), key=str)
    want = []
    for d, t, *_ in ODD:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    both = bpe.decode_documents(bpe.encode_documents(odd.drop("ids"), file, P.PATTERN), file, P.PATTERN)
    assert sorted((bytes(r.decoded) for r in both.collect())) == sorted((t or "").encode() for _, t, *_ in ODD)
    assert bpe.round_trip(odd.limit(0), file, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' .\n\t1é中s !")) | st.characters(exclude_categories=["Cs"]), max_size=60), st.integers(1, 12))
def test_bpe_pieces_give_the_same_ids(text, piece):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        e = bpe.encoding(f.read(), P.PATTERN)
    assert bpe.encode(e, P.PATTERN, text, piece) == e.encode_ordinary(text)
    assert "".join(bpe.safe_pieces(text, piece)) == text


def test_bpe_long_runs(enc):
    for text in (" " * 1_200_000 + "x", "word " * 60_000, "é" * 250_000):
        ids = bpe.encode(enc, P.PATTERN, text)
        assert enc.decode_bytes(ids) == text.encode()
    assert bpe.encode(enc, P.PATTERN, " " * 300_000 + "x") == enc.encode_ordinary(" " * 300_000 + "x")


def model_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = norm(low).strip(" ").split(" ") if norm(low).strip(" ") else []
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def model_components(fps):
    """Smallest key per component of keys with fingerprints, by all pairs."""
    keys = list(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_and_components(spark, odd):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(60)]
    for t in texts[:25]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append("\t".join(w))
    texts += [None, "", "One Two", "one two", "ÀB c d e", "x" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2 ** 64, r.component) for r in simhash.near_groups(df).collect()}
    fps = {i: model_fingerprint(t) for i, t in enumerate(texts)}
    assert {k: v[0] for k, v in got.items()} == fps
    assert {k: v[1] for k, v in got.items()} == model_components(fps)
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and simhash.near_groups(odd).count() == len(ODD)
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_masks_cover_every_set_of_four_positions():
    from itertools import combinations
    for level in range(3):
        masks = simhash.covering_masks(4, level)
        assert len(masks) == 31 and all(24 <= m.bit_count() <= 40 for m in masks)
        rng = random.Random(level)
        for c in [rng.sample(range(64), 4) for _ in range(3000)] + list(combinations(range(12), 4)):
            d = sum(1 << p for p in c)
            assert any(m & d == 0 for m in masks)


def test_buckets_end_at_a_fixed_size():
    kept = np.zeros(1, dtype=np.uint64)
    for level in range(4):
        kept = np.unique((kept[:, None] | np.array(simhash.covering_masks(4, level), dtype=np.uint64)[None, :]).ravel())
    assert 2 ** int((64 - np.bitwise_count(kept)).max()) <= simhash.BUCKET


def test_dense_clusters_keep_their_links_with_small_buckets(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(150):
            x = base
            for p in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << p
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = {x: x - 2 ** 64 if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    want = model_components({s: x for x, s in signed.items()})
    for bucket in (20, 4096):
        got = dict(components(simhash.radius_links(df, 4, bucket)).collect())
        assert {k: got.get(k, k) for k in want} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in root}


def test_shards_are_contiguous_and_even(spark, odd):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(3000)] + [(5000, None), (5001, "x" * 20000), (17, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shards.shard_documents(df, 40).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    assert set(size) <= set(range(40))
    target = sum(size.values()) / 40
    assert all(abs(v - target) <= 20016 for v in size.values())
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in ordered] == sorted(d for d, _ in rows)
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = {(d, t or "") for d, t in rows}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts}
    assert shards.shard_documents(odd, 40).count() == len(ODD) and shards.shard_documents(odd.limit(0), 40).count() == 0


def viterbi_model(score, switch):
    n, k = score.shape
    best, back = [score[0]], []
    for t in range(1, n):
        step = np.array([[best[-1][a] - (switch if a != b else 0) for a in range(k)] for b in range(k)])
        back.append(step.argmax(axis=1))
        best.append(step.max(axis=1) + score[t])
    path = [int(best[-1].argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    total = sum(score[t, x] for t, x in enumerate(path[::-1])) - switch * sum(a != b for a, b in zip(path, path[1:]))
    return path[::-1], total


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 7, 0, 30, 3, 30])
    score = -rng.random((sizes.sum(), 4)) * 20
    label = langid.viterbi(score, sizes, 12.0)
    at = 0
    for n in sizes:
        if n:
            part, got = score[at:at + n], label[at:at + n]
            total = sum(part[t, x] for t, x in enumerate(got)) - 12.0 * (got[1:] != got[:-1]).sum()
            assert total == pytest.approx(viterbi_model(part, 12.0)[1])
        at += n


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op5_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_training_sample_is_the_same_share_at_any_size(spark):
    assert langid.hash_bound(500, 10 ** 12) > 0 and langid.hash_bound(500, 3) == 2 ** 63 - 1
    many = spark.range(40_000).select(F.lit("aa").alias("lang"), F.concat(F.lit("text "), F.col("id") % 2000).alias("text"))
    langs, sample = langid.training_sample(many.union(spark.createDataFrame([("bb", "x"), ("bb", "x"), (None, "y")], "lang string, text string")), per_language=200)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert langs == ["aa", "bb"] and 140 <= sizes["aa"] <= 260 and sizes["bb"] == 1


def test_spans_of_mixed_and_odd_texts(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs)
    by = {r.lang: r.text for r in docs.where(F.length("text") > 800).dropDuplicates(["lang"]).collect()}
    a, b = by["en"][:500], by["de"][:500]
    mixed = langid.label_texts(model, [a + " " + b, "", "123 !?", "Привет мир"])
    spans = mixed["spans"][0]
    assert [s["lang"] for s in spans][0] == "en" and [s["lang"] for s in spans][-1] == "de"
    assert min(abs(s["end"] - 500) for s in spans) < 60
    assert list(mixed["lang"][1:3]) == ["und", "und"] and mixed["lang"][3] in model.langs
    got = odd.withColumn("l", langid.language(odd, model, spans=True)).collect()
    assert {r.l.lang for r in got if r.doc_id in (3, 4, 5, 6, 9)} == {"und"}
    assert langid.accepted(odd).columns == odd.columns
    assert langid.accepted(odd.limit(0)).count() == 0
    assert odd.limit(0).withColumn("l", langid.language(odd, langid.learn(odd.limit(0)))).count() == 0
