"""Language identification of whole texts, with spans of mixed-language text.

A word is a run of letters of one script. Its script narrows the languages to those seen with that script in training; letter trigrams
(hashed) score the rest. Viterbi over the words of a text, with a penalty for each change of language, labels the words; equal neighbours
are a span. The text's language is the one with most letters, its score that language's share of the letters.

Cases: a null text, or one without letters, or no training text at all, gives ``und``, score 0 and no spans; a script not seen in training
leaves all languages open; equal texts get equal results; ties go to the smaller language name; texts are scored whole, in memory
proportional to the text; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import packed, per_batch, slices, table

BUCKETS = 1 << 16
#: Nats a change of language costs, and the most one word can say against a language.
SWITCH, WORD_CAP = 12.0, 20.0
#: Languages a model may have; more distinct labels than that are an error in the labels.
MAX_LANGUAGES = 256

# First and last code point of the blocks of each script.
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_TOP = 0x32400  # no letters above


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0: no letter) and the script's number (0: another script)."""
    low, script = np.zeros(_TOP, dtype=np.uint32), np.zeros(_TOP, dtype=np.uint8)
    for c in range(_TOP):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            low[c] = ord(y) if len(y) == 1 else c
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a:b + 1] = k
    return low, script


class Words:
    """The words of some texts: for each its text, first and last position, number of letters and script; for each letter its trigram's bucket."""

    def __init__(self, texts: list[str]):
        low, script = _letters()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)])  # a zero stands between texts
        code = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le"), dtype=np.uint32)
        code = np.where(code < _TOP, code, 0)
        c = low[code]
        at = np.flatnonzero(c)
        kind = script[code[at]]
        del code
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])
        mix = (c[at - 1] * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) ^ (c[at + 1] * np.uint32(0xC2B2AE3D))
        self.bucket = (mix ^ (mix >> np.uint32(15))) & np.uint32(BUCKETS - 1)
        self.first = np.flatnonzero(first)
        last = np.concatenate([self.first[1:], [len(at)]]) - 1
        self.start, self.end = at[self.first] - 1, at[last] if len(at) else at  # less the leading zero; ends are exclusive
        self.letters, self.script = last - self.first + 1, kind[self.first]
        self.text = np.searchsorted(self.base, self.start, side="right") - 1


def _count(f: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for lang, g in f.groupby("lang"):
        w = Words(g["text"].tolist())
        n = np.concatenate([np.bincount(w.bucket, minlength=BUCKETS), np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS) + 1).astype(np.int64)])
        b = np.flatnonzero(n)
        parts.append(pd.DataFrame({"lang": lang, "bucket": b, "n": n[b]}))
    return pd.concat(parts) if parts else pd.DataFrame({"lang": [], "bucket": [], "n": []}).astype({"bucket": "int64", "n": "int64"})


class Model:
    """Languages, their trigram log probabilities (bucket x language) and whether they use a script (script x language)."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * BUCKETS)).astype(np.float32)
        self.uses = scripts > 1e-3 * np.maximum(scripts.sum(axis=0), 1)
        self.uses[~self.uses.any(axis=1)] = True


def hash_bound(wanted: int, distinct: int) -> int:
    """Hashes of 63 bits up to this bound are ``wanted`` of ``distinct`` texts, whatever their number."""
    return (2**63 - 1) * min(wanted, distinct) // max(distinct, 1)


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 500) -> tuple[list[str], DataFrame]:
    """The languages of the labelled rows of ``docs``, and lang, text of a sample by hash of the text: about ``per_language`` distinct texts of
    each language, or all if it has fewer. Copies of a text count once, so they make the sample neither larger nor smaller."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return langs, rows
    bound = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(hash_bound(per_language, sizes[k])).cast("long"))])
    return langs, rows.where(F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1)) <= bound[F.col("lang")]).dropDuplicates(["lang", "text"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 500) -> Model:
    """A model of a sample of the labelled rows. The sampled texts are counted whole; the driver gets at most (65,536 + scripts) counts for
    each language."""
    langs, sample = training_sample(docs, text, lang, per_language)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS) + 1, 0)))
    counts = sample.mapInPandas(per_batch(_count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(langs)))
    n[counts["bucket"], counts["lang"].map({k: i for i, k in enumerate(langs)})] = counts["n"]
    return Model(langs, n[:BUCKETS], n[BUCKETS:])


def viterbi(score: np.ndarray, n_words: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word. ``score``: words x labels, the words of text after text; ``n_words``: of each text. All texts step together."""
    label = np.zeros(len(score), dtype=np.int16)
    order = np.argsort(-n_words, kind="stable")
    begin = (np.cumsum(n_words) - n_words)[order]
    active = np.searchsorted(-n_words[order], -np.arange(n_words.max(initial=0)), side="left")  # texts with more than t words
    came = np.zeros(score.shape, dtype=np.int16)
    own = np.arange(score.shape[1], dtype=np.int16)
    value = None
    state = np.zeros(len(order), dtype=np.int16)
    for t, n in enumerate(active):
        rows = begin[:n] + t
        if t == 0:
            value = score[rows]
            came[rows] = own
        else:
            if n < len(value):
                state[n:len(value)] = value[n:].argmax(axis=1)
                value = value[:n]
            best = value.argmax(axis=1)
            value = value - value[np.arange(n), best][:, None]
            change = value < -switch
            came[rows] = np.where(change, best[:, None], own)
            value = np.maximum(value, -switch) + score[rows]
    if value is not None:
        state[:len(value)] = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = begin[:n] + t
        label[rows] = state[:n]
        state[:n] = came[rows, state[:n]]
    return label


def label_texts(model: Model, texts: list[str], spans: bool = True) -> pd.DataFrame:
    """lang, score and spans ((start, end, lang) in characters) of each text."""
    k, n = len(model.langs), len(texts)
    out = pd.DataFrame({"lang": ["und"] * n, "score": 0.0, "spans": [[] for _ in range(n)]}, columns=["lang", "score", "spans"])
    w = Words(texts)
    if not k or not len(w.first):
        return out if spans else out.drop(columns="spans")
    score = np.add.reduceat(model.logp[w.bucket], w.first, axis=0)
    score = np.where(model.uses[w.script], score, -np.inf)
    score = np.maximum(score - score.max(axis=1, keepdims=True), -WORD_CAP)
    label = viterbi(score, np.bincount(w.text, minlength=n))
    letters = np.bincount(w.text * k + label, weights=w.letters, minlength=n * k).reshape(n, k)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    some = total > 0
    names = np.array(model.langs, dtype=object)
    out.loc[some, "lang"] = names[best[some]]
    out.loc[some, "score"] = (letters[np.arange(n), best] / np.maximum(total, 1))[some]
    if not spans:
        return out.drop(columns="spans")
    new = np.ones(len(label), dtype=bool)
    new[1:] = (label[1:] != label[:-1]) | (w.text[1:] != w.text[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(label)]]) - 1
    offset = w.base[w.text[first]]
    for i, a, b, l in zip(w.text[first], w.start[first] - offset, w.end[last] - offset, label[first], strict=True):
        out["spans"].iat[i].append({"start": int(a), "end": int(b), "lang": model.langs[l]})
    return out


def language(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> Column:
    """A struct column (lang, score and, if asked for, spans) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "lang string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans

    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        most = 12_000_000 // max(4, len(m.langs))
        for s in parts:
            s = s.fillna("")
            made = [label_texts(m, s.iloc[x].tolist(), spans) for x in slices(s, most)]
            yield pd.concat(made, ignore_index=True) if made else label_texts(m, [], spans)

    label.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(label, kind)(F.col(text))


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from: CRC-32 of the key as text leaves 2 when divided by 4. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    out = docs.select("doc_id", held_out().alias("held_out"), language(docs, model).alias("l"))
    return out.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


def accepted(docs: DataFrame, least_score: float = 0.5, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that have a language: letters, and one language with at least ``least_score`` of them."""
    model = learn(docs.where(~held_out(key) & F.col(key).isNotNull()), text, lang)
    seen = packed(docs, found=language(docs, model, text))
    return seen.where((F.col("found.lang") != "und") & (F.col("found.score") >= least_score)).select("row.*")
