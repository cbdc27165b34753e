"""LM scores: the base score against exact counts, probabilities that add up, held-out gain, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from welltide.llm import maxent

HELD = "crc32(CAST(key AS string)) % 7 = 2"


def brute_base(rows):
    """{(key, text): (held, tokens, known, all, base)} from the contract, in whole numbers and plain Python."""
    import re

    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        return [*re.findall("[^\x20\x09-\x0d]+", low), None]

    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    c = Counter(w for k, t in rows if not held[k] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(k, t): (held[k], len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in rows}


def compared(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"held_out": F.lit(1), "key": F.lit(2), "base": F.lit("x")})
    got = maxent.scored(df, F.expr(HELD), **options).join(df.select("doc_id", "text").distinct(), "doc_id").collect()
    want = brute_base(rows)
    for r in got:
        held, tokens, known, n, base = want[r.doc_id, r.text]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-6
    return got


@pytest.mark.parametrize("named", [10, 1 << 16])
def test_base_score_and_gain(spark, named):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(3000)]
    follows = rng.integers(0, 3000, (3000, 3))

    def text(n):
        w, out = int(rng.integers(0, 3000)), []
        for _ in range(n):
            out.append(vocab[w] + ("É" if rng.random() < 0.01 else ""))
            w = int(follows[w, rng.integers(0, 3)]) if rng.random() < 0.9 else int(rng.zipf(1.5)) % 3000
        return " ".join(out)

    rows = [(i, text(int(rng.integers(1, 300)))) for i in range(600)]
    rows += [(700, None), (701, ""), (702, " \t\n\x0b "), (703, "UNSEEN Ä Ä w1\nW1"), (704, text(40_000)), (705, rows[0][1]), (706, "x" * 200_000)]
    got = compared(spark, rows, named=named)
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up(spark):
    """Over all words of the vocabulary and the unseen words' slots, after any two words."""
    texts = spark.createDataFrame([("a b c a b d %d" % (i % 40),) for i in range(400)] + [("z%d q" % i,) for i in range(2000)], "text string")
    counts = maxent.word_counts(texts)
    voc = maxent.vocabulary(counts)
    model = maxent.Model(voc, maxent.trained(texts, voc))
    assert np.abs(model.weights).max() > 0.1
    every = {bytes(r["word"]): r["c"] for r in counts.collect()}
    assert len(every) == voc.distinct > maxent.HEAD and sum(every.values()) == voc.tokens
    number = voc.number()
    unseen = [b"never" + bytes([97 + i]) for i in range(maxent.TAIL)]
    for a, b in [(b"a", b"b"), (b"never", b"a"), (b"q", b"z7")]:
        total, classes = 0.0, set()
        texts_ = [[a, b, w] for w in [*every, *unseen]]
        flat, num, word, context, first = maxent.labelled(texts_, number, voc.tail())
        at = first + 2
        one, two = maxent._contexts(context, first)
        logs = maxent.Block(model, word[at], one[at], two[at]).log10()
        for w, lp, n in zip([*every, *unseen], logs, word[at], strict=True):
            if n >= maxent.HEAD:
                lp += math.log10(every.get(w, 0) + 1) - model.tail[n - maxent.HEAD]
            total += 10**lp
            classes.add(n)
        assert total == pytest.approx(1.0, abs=1e-4)


def test_rows_that_repeat_and_empty_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (3, "b"), (None, "b a")]
    got = maxent.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.expr(HELD)).collect()
    assert len(got) == 5 and len({(r.base_score, r.score) for r in got if r.doc_id in (1, 2)}) == 1
    assert maxent.scored(spark.createDataFrame([], "doc_id long, text string"), F.expr(HELD)).count() == 0
    alone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = maxent.scored(spark.createDataFrame([(alone, "a b")], "doc_id long, text string"), F.expr(HELD)).first()
    assert (only.base_score, only.n_known, only.train_tokens) == (0.0, 0, 0) and only.score == pytest.approx(3 * math.log10(1 / maxent.TAIL), abs=1e-4)


def test_rows_of_weights_are_added_once_each():
    rng = np.random.default_rng(2)
    rows, values = rng.choice([3, 3, 3, 9, 100, 7], 5000), rng.random((5000, 4)).astype(np.float32)
    got, want = np.zeros((128, 4), np.float32), np.zeros((128, 4))
    maxent._add_rows(got, rows, values)
    np.add.at(want, rows, values)
    assert np.allclose(got, want, rtol=1e-4)


def test_most_frequent_words_with_ties(spark):
    rows = [(f"w{i}".encode(), 1 + (i * 7919) % 50 if i % 3 else 1000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "word binary, c long").repartition(9)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for most in (1, 600, 800, 1999, 5000):
        assert [(bytes(r.word), r.c) for r in maxent.most_frequent(df, most)] == want[:most]
    assert maxent.most_frequent(df.limit(0), 5) == []
