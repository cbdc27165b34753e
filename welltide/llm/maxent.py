"""A hashed maximum-entropy language model with a class-factored softmax, and the add-one unigram score beside it.

Words are counted over all training texts. The most frequent ones fill the slots of the head classes in order of frequency; every other word
belongs to a tail class named by its last byte. The probability of a word is that of its class given the two words before it, times that of
the word within its class: a second softmax in head classes, the add-one share of the word's count in tail classes, where one more slot stands
for all words never seen. Features are the word before, the one before that (a skip), and both together; each is hashed to a row of weights,
with the class as part of the hash in the second softmax. Without weights the model is the unigram model; probabilities add up to one.

Training goes over every training text once, in as many rounds as there are parts of the texts. A task of a round returns, for each row of
weights, how often each outcome was seen and how often the model expected it; the differences of all tasks are the gradient. A step divides
it by the logarithmic mean of both numbers and the number of features, which is the step of generalised iterative scaling. Sums and steps are made where
a row's parts meet; the driver gets the new weights, whose number is a parameter.

Scoring labels the words of a batch by a table of the ``named`` most frequent words and scores them with sparse rows of weights in blocks of
tokens. The counts of all other words are joined by word, so no table that grows with the vocabulary is held anywhere.

Cases: a null or empty text has one token, its end; a null key belongs to the training texts; rows that repeat a key or text are rows of
their own and count each; without training texts every token has base score 0 and the tail classes share the probability; an empty table
gives no rows; texts of any length are scored whole, in blocks; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import per_batch, table
from welltide.session import release, stage_path

#: Classes, those of them in the tail, words of a head class, and rows of weights of each softmax.
CLASSES, TAIL, SLOTS, ROWS = 32, 4, 32, 1 << 14
#: Frequent words whose numbers every task holds, parts of the training texts, and a constant added to seen and expected numbers.
NAMED, PARTS, PRIOR = 1 << 16, 3, 0.5
#: Largest weight.
LIMIT = 18.0
#: Features of a token, tokens of a block, distinct words a task counts before it hands them on, rows of weights summed together.
FEATURES, BLOCK, COUNTED, SLAB = 3, 1 << 14, 400_000, 16
HEAD = (CLASSES - TAIL) * SLOTS
_END = b"\n"  # no word


def words(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z in lower case; ``bytes`` does both for ASCII only, as wanted."""
    return text.encode("utf-8").lower().split() if text else []


# --- counts ---------------------------------------------------------------------------------------------

def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter[bytes] = Counter()
    for f in frames:
        for text in f["text"]:
            held.update(words(text))
            if len(held) > COUNTED:
                yield pd.DataFrame({"word": list(held), "c": list(held.values())})
                held.clear()
        held[_END] += len(f)
    yield pd.DataFrame({"word": list(held), "c": list(held.values())})


def word_counts(texts: DataFrame) -> DataFrame:
    """word (UTF-8; the end of a text is a line break), c over the rows of texts (text)."""
    return texts.mapInPandas(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def tail_class(last: np.ndarray) -> np.ndarray:
    """The tail class of words by their last byte."""
    return CLASSES - TAIL + last % TAIL


@dataclass
class Vocabulary:
    """The named words' numbers in order of frequency, their counts, all tokens and distinct words, and the tail classes' mass (counts plus one each)."""

    names: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    tail_mass: np.ndarray

    def number(self) -> Numbers:
        return Numbers((w, i) for i, w in enumerate(self.names))

    def tail(self) -> np.ndarray:
        """Tail class of each name by number; one more entry for -1."""
        return np.array([w[-1] for w in self.names] + [0], dtype=np.int64) % TAIL


def most_frequent(counts: DataFrame, most: int) -> list:
    """The ``most`` words of the largest counts. Levels of the counts' logarithms, a few thousand, tell from which one on words can be among
    them, so that tasks hand these words only to the driver and not as many as are wanted each."""
    level = F.floor(F.log2("c") * 32)
    at, total = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        at, total = r["level"], total + r["count"]
        if total >= most:
            break
    return counts.where(level >= at).orderBy(F.desc("c"), "word").limit(most).collect()


def vocabulary(counts: DataFrame, named: int = NAMED) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, max(named, HEAD))
    names, c = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], dtype=np.int64)
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
    mass = np.zeros(TAIL)
    for r in counts.groupBy((last % TAIL).alias("t")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["t"]] = r["m"]
    for w, x in zip(names[:HEAD], c[:HEAD], strict=False):
        mass[w[-1] % TAIL] -= x + 1
    return Vocabulary(names, c, tokens, distinct, mass)


# --- model ----------------------------------------------------------------------------------------------

class Model:
    """Weights of both softmaxes and the logarithms they start from."""

    def __init__(self, voc: Vocabulary, weights: np.ndarray | None = None):
        head = np.zeros(HEAD)
        head[:len(voc.counts[:HEAD])] = voc.counts[:HEAD] + 1.0
        head = head.reshape(-1, SLOTS)
        mass = np.concatenate([head.sum(axis=1), voc.tail_mass + 1.0])
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(mass / mass.sum()).astype(np.float32)
            self.slot_bias = np.log(head / np.maximum(head.sum(axis=1, keepdims=True), 1.0)).astype(np.float32)
        self.tail = np.log10(voc.tail_mass + 1.0)
        self.weights = np.zeros((2 * ROWS, CLASSES), dtype=np.float32) if weights is None else weights


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(kind * 0x165667B19E3779F9 & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64)


def _softmax(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Weights are at most LIMIT, so that no exponential of a sum of three overflows, and a row's sum never vanishes."""
    x = bias + weights.take(rows[0], axis=0)
    for r in rows[1:]:
        x += weights.take(r, axis=0)
    np.exp(x, out=x)
    x *= (1.0 / (x @ np.ones(x.shape[1], dtype=np.float32)))[:, None]
    return x


class Block:
    """Consecutive tokens with their rows of weights, and the model's probabilities of all classes and of all slots of head tokens' classes."""

    def __init__(self, model: Model, word: np.ndarray, before: np.ndarray, skip: np.ndarray):
        self.cls = np.where(word < HEAD, word // SLOTS, word - HEAD + CLASSES - TAIL)
        self.head = np.flatnonzero(word < HEAD)
        self.slot = word[self.head] % SLOTS
        zero = np.zeros(1, dtype=np.int64)
        context = [_mixed(before, zero, 1), _mixed(skip, zero, 2), _mixed(before, skip, 3)]
        self.rows = [x % ROWS for x in context]
        own = self.cls[self.head]
        self.slot_rows = [ROWS + _mixed(x[self.head], own, 4) % ROWS for x in context]
        self.p = _softmax(model.class_bias, model.weights, self.rows)
        self.q = _softmax(model.slot_bias.take(own, axis=0), model.weights, self.slot_rows)

    def log10(self) -> np.ndarray:
        """Of each token's class, and of the word in it where the class is of the head."""
        out = np.log10(np.maximum(self.p[np.arange(len(self.cls)), self.cls].astype(np.float64), 1e-30))
        out[self.head] += np.log10(np.maximum(self.q[np.arange(len(self.head)), self.slot].astype(np.float64), 1e-30))
        return out


class Numbers(dict):
    """Words to numbers; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def labelled(texts: list[list[bytes]], number: Numbers, named_tail: np.ndarray):
    """All tokens of some texts, their numbers, class or slot numbers, numbers as context, and the position of each text's first token.

    Words of the head have their numbers; other tokens have HEAD + (tail class - first tail class). As context every named word has its own
    number and all others share one for each tail class."""
    flat: list[bytes] = []
    for t in texts:
        flat += t
        flat.append(_END)
    num = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
    tail = named_tail[num]
    other = np.flatnonzero(num < 0)
    tail[other] = np.fromiter((flat[i][-1] for i in other.tolist()), dtype=np.int64, count=len(other)) % TAIL
    word = np.where((num >= 0) & (num < HEAD), num, HEAD + tail)
    context = np.where(num >= 0, num, (1 << 40) + tail)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)[:len(texts)]
    return flat, num, word, context, first


def _contexts(context: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that; numbers of their own where a text begins."""
    one, two = np.roll(context, 1), np.roll(context, 2)
    one[first], two[first] = 1 << 41, (1 << 41) + 1
    second = first[:-1][np.diff(first) > 1] + 1 if len(first) else first
    second = np.append(second, first[-1] + 1) if len(first) and first[-1] + 1 < len(context) else second
    two[second] = (1 << 41) + 1
    return one, two


def _blocks(model: Model, word: np.ndarray, context: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, Block]]:
    one, two = _contexts(context, first)
    for a in range(0, len(word), BLOCK):
        b = min(a + BLOCK, len(word))
        yield a, b, Block(model, word[a:b], one[a:b], two[a:b])


# --- training -------------------------------------------------------------------------------------------

def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """total[rows] += values, for repeated rows too: neighbours of sorted rows are added in pairs until each row stands once."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 2 * ROWS fit; sorted by digits
    at, v = rows[order], values.take(order, axis=0)
    while len(at):
        new = np.concatenate([[True], at[1:] != at[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        alone = start[size == 1]
        total[at[alone]] += v.take(alone, axis=0)
        place = np.arange(len(at)) - np.repeat(start, size)
        many = np.repeat(size, size)
        even = np.flatnonzero((many > 1) & (place % 2 == 0))
        paired = place[even] + 1 < many[even]
        nxt = v.take(even, axis=0)
        nxt[paired] += v.take(even[paired] + 1, axis=0)
        at, v = at[even], nxt


def _gradient(shared):
    """Seen and expected numbers of all rows of weights that a task's texts touch, in slabs of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc, weights = shared.value
        model, number, tails = Model(voc, weights), voc.number(), voc.tail()
        seen, expected = np.zeros(2 * ROWS * CLASSES, dtype=np.float32), np.zeros((2 * ROWS, CLASSES), dtype=np.float32)
        for f in per_batch(lambda x: x)(frames):
            _, _, word, context, first = labelled([words(t) for t in f["text"]], number, tails)
            for _, _, b in _blocks(model, word, context, first):
                for kinds, own, p in ((b.rows, b.cls, b.p), (b.slot_rows, b.slot, b.q)):
                    for r in kinds:
                        np.add.at(seen, r * CLASSES + own, np.float32(1))
                        _add_rows(expected, r, p)
        seen, expected = seen.reshape(-1, SLAB * CLASSES), expected.reshape(-1, SLAB * CLASSES)
        at = np.flatnonzero(expected.any(axis=1))
        yield pd.DataFrame({"slab": at, "seen": [seen[i].tobytes() for i in at], "expected": [expected[i].tobytes() for i in at]})

    return run


def scaled_step(seen: np.ndarray, expected: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """The gradient divided by the logarithmic mean of both numbers, and by the features of a token."""
    return (np.log(seen + prior) - np.log(expected + prior)) / FEATURES


def _step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of runs of a slab (rows come sorted by it) to the step of its weights."""
    slab, seen, expected = None, 0.0, 0.0
    for f in frames:
        for s, a, b in zip(f["slab"], f["seen"], f["expected"], strict=True):
            if s != slab:
                if slab is not None:
                    yield pd.DataFrame({"slab": [slab], "step": [scaled_step(seen, expected).astype(np.float32).tobytes()]})
                slab, seen, expected = s, 0.0, 0.0
            seen, expected = seen + np.frombuffer(a, np.float32).astype(np.float64), expected + np.frombuffer(b, np.float32).astype(np.float64)
    if slab is not None:
        yield pd.DataFrame({"slab": [slab], "step": [scaled_step(seen, expected).astype(np.float32).tobytes()]})


def trained(texts: DataFrame, voc: Vocabulary, parts: int = PARTS) -> np.ndarray:
    """The weights after one round over each of ``parts`` parts of the texts (text), dealt by hash."""
    spark = texts.sparkSession
    weights = np.zeros((2 * ROWS, CLASSES), dtype=np.float32)
    if not voc.tokens:
        return weights
    for part in range(parts):
        shared = spark.sparkContext.broadcast((voc, weights))
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        sums = mine.mapInPandas(_gradient(shared), "slab int, seen binary, expected binary").repartition("slab").sortWithinPartitions("slab")
        for r in sums.mapInPandas(_step, "slab int, step binary").collect():
            weights[r["slab"] * SLAB:(r["slab"] + 1) * SLAB] += np.frombuffer(r["step"], np.float32).reshape(SLAB, CLASSES)
        np.clip(weights, -LIMIT, LIMIT, out=weights)
        shared.unpersist()
    return weights


# --- scores ---------------------------------------------------------------------------------------------

def _scored(shared):
    """Per text: tokens, and of the named words how many are known and the sum of log10(c + 1); the model's part; the other words and how often they occur."""

    def make(f: pd.DataFrame, voc: Vocabulary, model: Model, number: Numbers, tails: np.ndarray, log_counts: np.ndarray) -> pd.DataFrame:
        flat, num, word, context, first = labelled([words(t) for t in f["text"]], number, tails)
        part = np.empty(len(flat))
        for a, b, block in _blocks(model, word, context, first):
            part[a:b] = block.log10()
        log_c = log_counts[num]
        tail = np.flatnonzero(word >= HEAD)
        part[tail] += log_c[tail] - model.tail[word[tail] - HEAD]
        ends = np.append(first[1:], len(flat))
        other = np.flatnonzero(num < 0)
        cuts = np.searchsorted(other, np.append(first, len(flat))).tolist()
        outside = [flat[i] for i in other.tolist()]
        rare = [Counter(outside[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"key": f["key"], "held_out": f["held_out"], "n_tokens": ends - first, "known": np.add.reduceat((num >= 0).astype(np.int64), first),
                             "base": np.add.reduceat(log_c, first), "model": np.add.reduceat(part, first), "rare": [list(c) for c in rare], "times": [list(c.values()) for c in rare]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc, weights = shared.value
        own = voc, Model(voc, weights), voc.number(), voc.tail(), np.append(np.log10(voc.counts + 1.0), 0.0)
        yield from per_batch(lambda f: make(f, *own))(f for f in frames if len(f))

    return run


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", named: int = NAMED, parts: int = PARTS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; texts that ``held_out`` (over column ``key``) marks are not learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    texts = rows.where(~F.col("held_out")).select("text")
    counts, counts_path = stage_path(word_counts(texts), "maxent-counts")
    voc = vocabulary(counts, named)
    shared = spark.sparkContext.broadcast((voc, trained(texts, voc, parts)))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<binary>, times array<long>"
    # Numbers name rows only from here on, where they are written.
    some = rows.mapInPandas(_scored(shared), schema).withColumn("row_id", F.monotonically_increasing_id())
    store, path = stage_path(some, "maxent-scores")
    rare = store.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row_id", F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    hits = rare.join(counts, "word").groupBy("row_id").agg(F.sum("n").alias("hits"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("extra"))
    whole = F.lit(float(np.log10(voc.tokens + voc.distinct + 1.0)))
    extra = F.coalesce("extra", F.lit(0.0))
    out = store.drop("rare", "times").join(hits, "row_id", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * whole).alias("base_score"), (F.col("model") + extra).alias("score"))
    done, _ = stage_path(out, "maxent-results")
    release(spark, path, counts_path)
    return done


def op13_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents`` by a model of those whose remainder is not 2."""
    return scored(table(spark, sf_dir, "documents"), F.crc32(F.col("key").cast("string")) % 7 == 2)
