"""Nearest neighbours, URL lists, perspective rotation, licences, mixing and the pipeline against brute force and known answers."""

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from welltide.llm import ann, chat, licences, mixing, queries, urls

TABLES = "documents embeddings pages benchmark labels conversations".split()


# --- nearest neighbours ---------------------------------------------------------------------------------

def brute(rows, queries_of, k):
    """Exact answers on padded vectors; rows: {id: vector}."""
    d = max(len(v) for v in rows.values())
    ids = sorted(rows)
    x = np.array([np.pad(np.array(rows[i], float), (0, d - len(rows[i]))) for i in ids])
    out = {}
    for q in filter(queries_of, ids):
        s = x @ x[ids.index(q)]
        out[q] = sorted(((-s[j], i) for j, i in enumerate(ids) if i != q))[:k]
    return out


def test_recall_and_exact_scores(spark, sf):
    got = ann.op1_ann(spark, sf).collect()
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(rows, lambda i: i % 20 == 0, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        exact = sum(float(a) * float(b) for a, b in zip(rows[r.query_id], rows[r.vec_id]))
        assert r.score == pytest.approx(exact, abs=1e-12)
    assert set(by) == set(want)
    hits = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(r.vec_id != q for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        hits += len({r.vec_id for r in rs} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_norms_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = {i: (rng.standard_normal(16) * rng.choice([0.1, 1, 30])).tolist() for i in range(400)}
    for i in range(400, 520):
        rows[i] = rows[40]  # a vector that many rows share
    rows[600] = rows[7][:9]  # shorter
    bad = [(1001, None), (1002, []), (1003, [0.0] * 16), (1004, [float("nan")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (3, rows[3])]
    df = spark.createDataFrame([*rows.items(), *bad], "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "vec": F.lit(2), "rep": F.lit(3), "q": F.lit(0)})
    got = ann.nearest(df, F.pmod(F.col("id"), F.lit(20)) == 0, 20).collect()
    want = brute(rows, lambda i: i % 20 == 0, 20)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(by) == set(want)
    same = sum(len({i for _, i in by[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
    assert same >= 0.95 and all(len(v) == 20 for v in by.values())
    assert {i for _, i in by[40]} == {i for _, i in want[40]}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, F.col("id") % 20 == 0, 20).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert ann.nearest(few.limit(0), F.col("id") == 0, 20).count() == 0
    assert ann.nearest(few.limit(1), F.col("id") == 0, 20).count() == 0


# --- queries that SQL checks ------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toArrow()
    con.register("got", got)
    con.execute(f"CREATE TEMP TABLE want AS {queries.ORACLES[name]}")
    cols = ", ".join(sorted(got.column_names))
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []
    assert got.num_rows > 0


# --- URL lists ----------------------------------------------------------------------------------------------

def day(n):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n)


CHANGES = "list string, effect string, kind string, pattern string, action string, at timestamp"


def test_entries_count_only_while_they_are_listed(spark):
    changes = spark.createDataFrame([
        ("ads", "block", "domain", "ads.example", "add", day(10)), ("ads", "block", "domain", "ads.example", "remove", day(80)), ("ads", "block", "domain", "ads.example", "add", day(200)),
        ("own", "allow", "host", "good.ads.example", "add", day(0)), ("bad", "block", "prefix", "site.example/private/", "add", day(5)), ("bad", "block", "prefix", "site.example/private/", "add", day(6)),
        ("take", "block", "url", "site.example/page?x=1", "add", day(50)), ("take", "block", "url", "site.example/page?x=1", "remove", day(50)),
        ("none", "block", "host", None, "add", day(0)), (None, "block", "host", "site.example", "add", day(0)), ("none", "block", "host", "site.example", "add", None), ("odd", "block", "shape", "site.example", "add", day(0))], CHANGES)
    cases = [
        ("http://x.ads.example/", day(9), "pass"), ("http://x.ads.example/", day(10), "block"), ("https://X.Ads.Example:8080/a", day(79), "block"), ("http://u@x.ads.example./", day(80), "pass"),
        ("http://x.ads.example/", day(250), "block"), ("http://good.ads.example/", day(20), "allow"), ("http://bads.example/", day(20), "pass"), ("http://site.example/private/a/b", day(7), "block"),
        ("http://site.example/private", day(7), "pass"), ("http://site.example/page?x=1#top", day(60), "block"), ("http://site.example/page?x=2", day(60), "pass"), (None, day(60), "pass"),
        ("not a url", day(60), "pass"), ("http://x.ads.example/", None, "pass"), ("", day(1), "pass")]
    caps = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)] * 2, "page_id long, url string, fetched timestamp").withColumns({"list": F.lit(1), "rows": F.lit(1), "hit": F.lit(1), "key": F.lit(1)})
    got = urls.judge(caps, changes, "page_id").collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted([(i, v) for i, (_, _, v) in enumerate(cases)] * 2)
    assert {r.n_active for r in got if r.page_id == 5} == {2}
    assert urls.judge(caps.limit(0), changes, "page_id").count() == 0
    assert {r.verdict for r in urls.judge(caps, changes.limit(0), "page_id").collect()} == {"pass"}


# --- dialogues ---------------------------------------------------------------------------------------------

def test_every_participant_is_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello <|im_end|> you"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, 0, None, "é"), (None, 0, "x", "y"),
            (4, None, "z", "loose"), (5, 0, "a\nb", "t"), (6, 0, "p", "1"), (6, 64, "q", "2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(0), "part": F.lit(0), "who": F.lit("w"), "turns": F.lit(1)})
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "x"), (4, "z"), (5, "a b"), (6, "p"), (6, "q")}
    assert {k[2] for k in got if k[0] == 6} == {0, 1} and all(k[2] < 0 for k in got if k[0] == 4)
    a = got[(1, "ann", 0)]
    assert a.rendered == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nHello < |im_end|> you<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert [a.rendered[s.start:s.end] for s in a.spans] == ["Hi<|im_end|>", "<|im_end|>"] and a.n_trained == 22 and a.n_turns == 4
    b = got[(1, "bob", 0)]
    assert [b.rendered[s.start:s.end] for s in b.spans] == ["Hello < |im_end|> you<|im_end|>"] and "user name=ann" in b.rendered
    assert chat.rotate(df.limit(0)).count() == 0


def test_crowded_turn_numbers_are_dealt_to_pieces(spark, tmp_path):
    rows = [(None, 3, "ann", f"text {i}") for i in range(500)] + [(None, 3, "bob", "same")] * 700 + [(None, 4, "ann", "next"), (1, 3, "ann", "calm")] + [(2, None, "eve", "lost")] * 200
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    out = chat.op4_chat_rotation(spark, str(tmp_path)).toPandas()
    hot = out[out.conv_id.isna() & (out.perspective == "ann")]
    assert hot.n_turns.sum() == 1201 and hot.n_turns.max() < 300 and hot[hot.piece == 0].n_turns.tolist() == [1]
    assert sum(r.count("same<|im_end|>") for r in hot.rendered) == 700 and sum(r.count("text 77<|im_end|>") for r in hot.rendered) == 1
    assert out[out.conv_id == 2].n_turns.sum() == 200 and out[out.conv_id == 1].piece.tolist() == [0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    con.register("got", out)
    names = ", ".join(out.columns)
    both = f"(SELECT {names} FROM got EXCEPT ALL SELECT {names} FROM want) UNION ALL (SELECT {names} FROM want EXCEPT ALL SELECT {names} FROM got)"
    con.execute(f"CREATE TABLE want AS {chat.OP4_SQL}")
    assert con.execute(both).fetchall() == []


# --- licences ------------------------------------------------------------------------------------------------

def test_rules_take_sequences_in_order(spark):
    text = {n: s for s, n in ((s, n) for n, s in licences.SENTENCES)}
    first = {}
    for n, s in licences.SENTENCES:
        first.setdefault(n, s)
    full = f"Some code.\n{first['mit_name']}\n{first['mit_grant']}:\n{first['mit_keep']}.\n{first['mit_as_is']}. And more."
    cases = [(1, full, ["MIT"], []), (2, f"Text. {first['apache_notice']}.", ["Apache-2.0"], []), (3, f"{first['mit_keep']}. {first['mit_grant']}.", [], ["mit_keep", "mit_grant"]),
             (4, f"{first['cc_by_nc_4']}.\n{first['gpl3_work']}.", ["GPL-3.0-only", "CC-BY-NC-4.0"], []), (5, None, [], []), (6, "", [], []), (7, "licensed " * 5000, [], []),
             (8, f"{first['bsd_grant']}:\n{first['bsd_source']}.\n{first['bsd_binary']}.\n", ["BSD-2-Clause"], []), (9, f"the quote {first['cc_by_4']} inside", [], []), (10, f"{first['mpl_terms']}.", ["MPL-2.0"], [])]
    assert text
    df = spark.createDataFrame([(i, t) for i, t, _, _ in cases], "doc_id long, text string").withColumns({"key": F.lit(1), "ids": F.lit(1), "r": F.lit(1)})
    got = {r.doc_id: (list(r.licences), list(r.unused)) for r in licences.scan(df).collect()}
    assert got == {i: (a, b) for i, _, a, b in cases}
    assert licences.scan(df.limit(0)).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------

def test_raking_meets_all_margins():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 1000))) for i in range(5) for j in range(3) for k in range(2)], columns=["source", "lang", "topic", "mass"])
    goal = {"source": {f"s{i}": i + 1 for i in range(5)}, "lang": {"l0": 1, "l1": 1, "l2": 2}, "topic": None}
    got = mixing.cell_rates(cells, ["source", "lang", "topic"], goal, 0.5)
    assert got.weight.sum() == pytest.approx(1) and got.rate.max() == pytest.approx(1)
    for i in range(5):
        assert got[got.source == f"s{i}"].weight.sum() == pytest.approx((i + 1) / 15)
    assert got[got.lang == "l2"].weight.sum() == pytest.approx(0.5)
    top = cells.groupby("topic").mass.sum() ** 0.5
    assert got.groupby("topic").weight.sum().to_numpy() == pytest.approx((top / top.sum()).to_numpy(), rel=1e-6)
    ratio = (got.rate * got.mass) / got.weight
    assert ratio.max() == pytest.approx(ratio.min())


def test_targets_that_contradict_each_other_are_refused():
    cells = pd.DataFrame([("a", "x", "t", 100.0), ("a", "y", "t", 100.0), ("b", "x", "t", 100.0)], columns=["source", "lang", "topic", "mass"])
    own = ["source", "lang", "topic"]
    with pytest.raises(ValueError, match="source by 0.4000"):  # (b, y) has no documents
        mixing.cell_rates(cells, own, {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.3, "y": 0.7}}, 0.5)
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.cell_rates(cells[1:], own, {"source": {"a": 1.0}, "lang": {"x": 1.0}}, 0.5)  # nothing is left
    slow = mixing.cell_rates(cells, own, {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}}, 0.5)
    assert slow.weight.tolist() == pytest.approx([0.1, 0.5, 0.4], abs=mixing.TOLERANCE) and slow.gap.max() <= mixing.TOLERANCE
    more = pd.concat([cells, pd.DataFrame([("c", "x", "t", 100.0)], columns=cells.columns)])  # y wants a half, but only a has it
    with pytest.warns(UserWarning, match="not all met"):
        assert mixing.cell_rates(more, own, {"source": None}, 0.0).weight.sum() == pytest.approx(1)


def test_draws_follow_their_rates(spark):
    rows = [(i, f"text {i} " * 5, "en" if i % 4 else None, "a" if i % 3 else "b", 1) for i in range(6000)] + [(7000, None, "en", "a", 0), (None, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "rate": F.lit(1), "topic": F.lit(1), "s": F.lit(1)})
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, None: 0.5}}
    out = mixing.mixed(df, targets=goal)
    assert out.columns == df.columns
    kept = out.toPandas()
    assert abs((kept.source == "a").mean() - 0.5) < 0.05 and abs(kept.lang.isna().mean() - 0.5) < 0.05
    assert sorted(kept.doc_id.dropna()) == sorted(mixing.mixed(df.repartition(3), targets=goal).toPandas().doc_id.dropna())
    assert mixing.mixed(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(df, targets={"source": {"zzz": 1.0}}).count()


# --- pipeline ------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now, kept = docs, [docs.count()]
    for _, fn in corpus_pipeline.STAGES[:-1]:
        nxt = fn(spark, now, sf)
        assert nxt.columns == docs.columns
        nxt = nxt.cache()
        kept.append(nxt.count())
        assert nxt.join(now, docs.columns, "left_anti").count() == 0
        now = nxt
    assert kept == sorted(kept, reverse=True) and kept[1] > 0.9 * kept[0] and math.prod(kept) > 0
    whole = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {r.doc_id for r in now.collect()}
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), sf).count() == 0
