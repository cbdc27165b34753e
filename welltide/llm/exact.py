"""Exact deduplication with compressed radix tries.

Texts are normalised (each run of white space becomes one blank). Rows are owned by partitions of (length, content hash); an owner inserts
the full byte strings into a Patricia trie whose terminal nodes hold the smallest identifier and a count. Every map task first runs its own
texts through a trie, so a text held by a third of all rows reaches its owner once per task batch. An owner's rows come sorted by (length,
hash), which are the first bytes of the trie's keys: subtrees behind the current one are complete, and when the trie holds more than its
bytes they are spilled, that is, given out as result rows and freed.

Cases: a null text counts as empty; a text of white space only is one blank; equal rows and equal keys count as rows of their own; rows
with a null key are compared like all others and a null key is the smallest only if no other is there; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import WS_CLASS, packed, table

#: Bytes a trie may hold before its finished subtrees are given out.
TRIE_BYTES = 48 << 20
#: Bytes counted for a node beside its label: the objects of node, children, label and identifier; and for a terminal node's digest.
NODE_BYTES, DIGEST_BYTES = 400, 120
_HEAD = 12  # bytes of length and hash in front of each key


class _Node:
    __slots__ = ("label", "kids", "least", "count", "digest")

    def __init__(self, label: bytes):
        self.label, self.kids, self.least, self.count, self.digest = label, {}, None, 0, None


class PatriciaTrie:
    """Byte strings in a compressed radix trie; ``held`` counts the bytes of its edge labels, nodes and digests."""

    def __init__(self):
        self.root, self.held = _Node(b""), 0

    def insert(self, key: bytes, identifier: int | None, count: int, digest: str) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = _Node(key[at:])
                node.kids[key[at]] = kid
                self.held += len(kid.label) + NODE_BYTES
                node, at = kid, len(key)
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)  # the first byte is equal; find how many are
            while low < high:
                mid = (low + high + 1) // 2
                if key.startswith(label[:mid], at):
                    low = mid
                else:
                    high = mid - 1
            top = _Node(label[:low])
            kid.label = label[low:]
            top.kids[kid.label[0]] = kid
            node.kids[key[at]] = top
            self.held += NODE_BYTES
            node, at = top, at + low
        if identifier is not None and (node.least is None or identifier < node.least):
            node.least = identifier
        if not node.count:
            self.held += DIGEST_BYTES
        node.count, node.digest = node.count + count, digest

    def take(self) -> Iterator[tuple[bytes, int | None, int, str]]:
        """All strings with their least identifier, count and digest, subtree by subtree; the trie is empty afterwards."""
        stack = [(self.root, b"")]
        self.root, self.held = _Node(b""), 0
        while stack:
            node, before = stack.pop()
            path = before + node.label
            if node.count:
                yield path, node.least, node.count, node.digest
            stack.extend((kid, path) for kid in node.kids.values())


def _head(length: int, h: int) -> bytes:
    return length.to_bytes(4, "big") + (h & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")


def _combine(limit: int):
    """Map side: the batch's equal texts become one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = PatriciaTrie()

        def out() -> pd.DataFrame:
            rows = [(int.from_bytes(k[:4], "big"), int.from_bytes(k[4:_HEAD], "big", signed=True), k[_HEAD:], least, n, d) for k, least, n, d in trie.take()]
            return _frame(rows, ["len", "h", "body", "least", "n", "sha"])

        for f in frames:
            for i, n, h, body, sha in zip(f["id"], f["len"], f["h"], f["body"], f["sha"], strict=True):
                trie.insert(_head(n, h) + bytes(body), None if pd.isna(i) else int(i), 1, sha)
                if trie.held > limit:
                    yield out()
        if trie.held:
            yield out()

    return run


def _own(limit: int):
    """Owner side: rows sorted by (len, h) into a trie; finished subtrees are given out when it is full."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, head = PatriciaTrie(), b""

        def out() -> pd.DataFrame:
            return _frame([(d, least, n) for _, least, n, d in trie.take()], ["sha", "least", "n"])

        for f in frames:
            for n, h, body, least, count, sha in zip(f["len"], f["h"], f["body"], f["least"], f["n"], f["sha"], strict=True):
                now = _head(n, h)
                if now != head and trie.held > limit:
                    yield out()
                head = now
                trie.insert(now + bytes(body), None if pd.isna(least) else int(least), int(count), sha)
        if trie.held:
            yield out()

    return run


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=names)
    return f.assign(least=f["least"].astype("Int64")) if "least" in f else f


def normalised(text: str | Column) -> Column:
    """Text with each run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WS_CLASS + "+", " ")


def owners(docs: DataFrame, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (smallest key), group_size."""
    src = docs.select(F.col(key).cast("long").alias("id"), normalised(text).alias("_t"))
    src = src.select("id", F.octet_length("_t").alias("len"), F.xxhash64("_t").alias("h"), F.encode("_t", "UTF-8").alias("body"), F.sha2("_t", 256).alias("sha"))
    local = src.mapInPandas(_combine(trie_bytes // 4), "len int, h long, body binary, least long, n long, sha string")
    dealt = local.repartition("len", "h").sortWithinPartitions("len", "h")
    found = dealt.mapInPandas(_own(trie_bytes), "sha string, least long, n long")
    return found.select(F.col("sha").alias("text_sha256"), F.col("least").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256. ``kept`` marks the rows whose key is the smallest of their group.

    Documents find their group by digest; a digest's rows may be many, and the join's large partitions are split by adaptive execution.
    """
    light = docs.select(F.col(key), F.sha2(normalised(text), 256).alias("text_sha256"))
    return (light.join(owners(docs, key, text, trie_bytes), "text_sha256")
            .select(key, "keep_id", "group_size", F.col(key).cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct normalised text, with their columns. Of rows with the same key and text one stays."""
    rows = packed(docs, digest=F.sha2(normalised(text), 256), key=F.col(key).cast("long"))
    hit = (F.col("digest") == F.col("text_sha256")) & F.col("key").eqNullSafe(F.col("keep_id"))
    return rows.join(owners(docs, key, text), hit).dropDuplicates(["digest"]).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all whole texts of ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
