"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent and greedy search in it.

Vectors are scaled by the largest norm and get one more component that would make all norms one, so that the largest inner product is the
nearest point. Codes of four-byte floats steer graph and search; the added component is held as its distance from one, and the graph goes by
distances from a group's mean, so that neither near copies nor a few long vectors cost precision. Scores are computed from the original
vectors, for every node of a beam that the codes' rounding could move among the best. Equal vectors share a node.

The graph starts from random projection trees (ranges of a random projection, divided at medians inside a task). In each round every node
sends its code to itself and its neighbours; each receiver compares a bounded sample of the nodes that meet there, which are neighbours of
neighbours, and proposes the best pairs; proposals replace worse neighbours. Search keeps a beam of nodes per query; each round joins the best nodes not
yet opened with their adjacency. Nothing is collected but counts, norms and a few entry nodes.

Cases: null ids, and vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors shorter than the longest
count as padded with zeros; an id that is repeated keeps its smallest vector in array order; ties go to the smaller id; fewer candidates than
asked for are all returned as far as the search reaches them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from welltide.llm.common import table
from welltide.session import release, scratch_path, stage_path

#: Neighbours of a node, nodes of a leaf and trees of the first graph, nodes that meet in one place, proposals one of them gets there, rounds at most.
DEGREE, LEAF, TREES, MEETING, PROPOSALS, ROUNDS = 24, 96, 3, 64, 6, 5
#: Beam, nodes opened per query and round, search rounds at most, candidates scored exactly per query at least.
BEAM, OPEN, SEARCH_ROUNDS, EXACT = 448, 128, 16, 64
#: The search ends when at most this share of all beams' nodes has not been opened.
UNOPENED = 0.01
#: Points of one partition of a tree, which a task divides in memory; neighbours in one row of the adjacency table.
TREE_POINTS, TOGETHER = 1 << 16, 6


# --- packed columns -------------------------------------------------------------------------------------

def _flat(column: pd.Series, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(column), dtype=dtype), np.fromiter((len(x) // size for x in column), dtype=np.int64, count=len(column))


def _packed(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    width, raw = values.itemsize, values.tobytes()
    ends = np.cumsum(sizes) * width
    return [raw[a:b] for a, b in zip(ends - sizes * width, ends, strict=True)]


def encode_unit(x: np.ndarray) -> np.ndarray:
    """Rows (of norm one at most) and 1 - sqrt(1 - norm²) as bytes of four-byte floats."""
    square = (x * x).sum(axis=1)
    rest = square / (1.0 + np.sqrt(np.maximum(0.0, 1.0 - square)))
    return np.ascontiguousarray(np.concatenate([x, rest[:, None]], axis=1), dtype=np.float32).view(np.uint8)


def decode_unit(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(np.float32)


def nearness(x: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all pairs of rows."""
    x = x.astype(np.float64)
    x -= x.mean(axis=0)
    square = (x * x).sum(axis=1)
    return np.minimum(2.0 * (x @ x.T) - square[:, None] - square[None, :], 0.0).astype(np.float32)


def _codes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def _whole_runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames cut so that no run of equal ``key`` is divided (rows come sorted by it)."""
    tail = None
    for f in frames:
        f = f if tail is None else pd.concat([tail, f], ignore_index=True)
        k = f[key].to_numpy()
        cut = np.searchsorted(k, k[-1], side="left") if len(k) else 0
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        tail = f.iloc[cut:].reset_index(drop=True)
    if tail is not None and len(tail):
        yield tail


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, flags: np.ndarray, most: int):
    """Of the entries of each owner the ``most`` best, each id once (with the smallest flag it came with), best first."""
    o = np.lexsort((flags, ids, owner))
    owner, ids, sims, flags = owner[o], ids[o], sims[o], flags[o]
    first = np.ones(len(o), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims, flags = owner[first], ids[first], sims[first], flags[first]
    o = np.lexsort((ids, -sims, owner))
    owner, ids, sims, flags = owner[o], ids[o], sims[o], flags[o]
    start = np.searchsorted(owner, owner, side="left")
    top = np.arange(len(owner)) - start < most
    return owner[top], ids[top], sims[top], flags[top]


# --- vectors and nodes ----------------------------------------------------------------------------------

def usable(vec: str) -> Column:
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def clean_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """id, vec (doubles, without trailing zeros beyond the longest) of the rows that take part, one per id."""
    ok = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.coalesce(usable("vec"), F.lit(False)))
    one = ok.groupBy("id").agg(F.min("vec").alias("vec"))
    return one


def _unit(dim: int, norm: float):
    """Vectors to codes of unit length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.zeros((len(f), dim))
            for i, v in enumerate(f["vec"]):
                x[i, :len(v)] = v
            x /= norm
            yield pd.DataFrame({"id": f["id"], "code": [r.tobytes() for r in encode_unit(x)]})

    return run


# --- graph ----------------------------------------------------------------------------------------------

def _leaves(points: np.ndarray, rng: np.random.Generator, leaf: int) -> Iterator[np.ndarray]:
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) <= leaf:
            yield at
            continue
        p = points[at].astype(np.float64) @ rng.standard_normal(points.shape[1])
        order = np.argsort(p, kind="stable")
        stack += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]


def _along(direction: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(p=decode_unit(_codes(f["code"])) @ direction) if len(f) else f.assign(p=np.float32(0))

    return run


def _tree(degree: int, leaf: int, seed: int):
    """A partition of points to each point's best leaf mates, and one mate at random (far, to keep the graph in one piece)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        f = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if not len(f):
            return
        ids, x, rng = f["id"].to_numpy(), decode_unit(_codes(f["code"])), np.random.default_rng(seed)
        ring = rng.permutation(len(ids))
        mate = np.empty(len(ids), dtype=np.int64)
        mate[ring] = ids[np.roll(ring, 1)]
        for at in _leaves(x, rng, leaf):
            s = nearness(x[at])
            np.fill_diagonal(s, -np.inf)
            k = min(degree, len(at) - 1)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            near, sims = ids[at][top], np.take_along_axis(s, top, axis=1).astype(np.float32)
            yield pd.DataFrame({"id": ids[at], "nbr": [r.tobytes() for r in near], "sim": [r.tobytes() for r in sims], "fresh": [b"\x01" * k] * len(at), "far": [r.tobytes() for r in mate[at]]})

    return run


_STATE = "id long, code binary, nbr binary, sim binary, fresh binary, far binary, changed long"


def _merge(degree: int):
    """Runs of an id: its state or code, and proposals. Gives the state with the best neighbours; added ones are fresh."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_runs(frames, "id"):
            ids, owner = np.unique(f["id"].to_numpy(), return_inverse=True)
            nbr, n = _flat(f["nbr"], np.int64)
            sim, _ = _flat(f["sim"], np.float32)
            fresh, _ = _flat(f["fresh"], np.uint8)
            row = np.repeat(owner, n)
            other = nbr != ids[row]
            o, b, s, g = _best(row[other], nbr[other], sim[other], fresh[other], degree)
            sizes = np.bincount(o, minlength=len(ids))
            code = np.full(len(ids), None, dtype=object)
            far = np.full(len(ids), b"", dtype=object)
            for i, c, x in zip(owner, f["code"], f["far"], strict=True):
                if c is not None:
                    code[i] = c
                far[i] += x
            added = np.bincount(o, weights=g == 2, minlength=len(ids)).astype(np.int64)
            out = pd.DataFrame({"id": ids, "code": code, "nbr": _packed(b, sizes), "sim": _packed(s.astype(np.float32), sizes),
                                "fresh": _packed(np.minimum(g, 1).astype(np.uint8), sizes), "far": far, "changed": added})
            yield out[out["code"].notna()]  # proposals for what is no node cannot be

    return run


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each neighbour learns who has it: id (the neighbour), other (who), fresh."""
    for f in frames:
        nbr, n = _flat(f["nbr"], np.int64)
        fresh, _ = _flat(f["fresh"], np.uint8)
        yield pd.DataFrame({"id": nbr, "other": np.repeat(f["id"].to_numpy(), n), "fresh": fresh.astype(np.int32)})


def _send(degree: int, with_far: bool):
    """Runs of an id: its state and the sample of those that have it. Sends the code to all of them: to, id, code, worst, fresh, kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_runs(frames, "id"):
            for i, g in _groups(f):
                state = next((x for x in g if x[1] is not None), None)
                if state is None:
                    continue
                code, nbr, sim = state[1], np.frombuffer(state[2], np.int64), np.frombuffer(state[3], np.float32)
                fresh = np.frombuffer(state[4], np.uint8).astype(np.int32)
                back = np.array([x[6] for x in g if x[1] is None], dtype=np.int64)
                back_fresh = np.array([x[7] for x in g if x[1] is None], dtype=np.int32)
                far = np.frombuffer(state[5], np.int64) if with_far else np.zeros(0, np.int64)
                to, at = np.unique(np.concatenate([[i], nbr, back, far]).astype(np.int64), return_inverse=True)
                new = np.zeros(len(to), dtype=np.int32)
                np.maximum.at(new, at, np.concatenate([[0], fresh, back_fresh, np.zeros(len(far), np.int32)]).astype(np.int32))
                yield to, i, code, float(sim[-1]) if len(sim) >= degree else -np.inf, new

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for x in run(frames):
            held.append(x)
            n += len(x[0])
            if n > 100_000:
                yield _sent(held)
                held, n = [], 0
        if held:
            yield _sent(held)

    return rows


def _sent(held: list) -> pd.DataFrame:
    size = [len(x[0]) for x in held]
    return pd.DataFrame({"to": np.concatenate([x[0] for x in held]), "id": np.repeat(np.array([x[1] for x in held], dtype=np.int64), size),
                         "code": np.repeat(np.array([x[2] for x in held], dtype=object), size), "worst": np.repeat(np.array([x[3] for x in held], dtype=np.float32), size),
                         "fresh": np.concatenate([x[4] for x in held])})


def _groups(f: pd.DataFrame):
    """(id, rows) of consecutive equal ids; rows are tuples of the frame's columns."""
    ids = f["id"].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
    data = list(zip(*(f[c] for c in f.columns), strict=True))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(ids[a]), data[a:b]


def _meet(proposals: int):
    """Runs of ``to``: the nodes that meet there. Each gets the best others as proposals, if better than its worst neighbour."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_runs(frames, "to"):
            to, ids = f["to"].to_numpy(), f["id"].to_numpy()
            x, worst, fresh = decode_unit(_codes(f["code"])), f["worst"].to_numpy(), f["fresh"].to_numpy() > 0
            cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
            who, near, sims = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                new = fresh[a:b]
                if b - a < 2 or not new.any():
                    continue
                s = nearness(x[a:b])
                s[~(new[:, None] | new[None, :]) | (s <= worst[a:b, None])] = -np.inf
                np.fill_diagonal(s, -np.inf)
                k = min(proposals, b - a - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                v = np.take_along_axis(s, top, axis=1)
                good = np.isfinite(v)
                r = np.nonzero(good)[0]
                who.append(ids[a:b][r])
                near.append(ids[a:b][top[good]])
                sims.append(v[good])
            if not who:
                continue
            who, near, sims = np.concatenate(who), np.concatenate(near), np.concatenate(sims)
            o = np.argsort(who, kind="stable")
            who, near, sims = who[o], near[o], sims[o].astype(np.float32)
            owner, size = np.unique(who, return_counts=True)
            yield pd.DataFrame({"id": owner, "nbr": _packed(near, size), "sim": _packed(sims, size), "fresh": _packed(np.full(len(near), 2, np.uint8), size)})

    return run


def _post(degree: int):
    """Each node's code for itself and its neighbours: to, id, code, worst, fresh."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            nbr, n = _flat(f["nbr"], np.int64)
            sim, _ = _flat(f["sim"], np.float32)
            fresh, _ = _flat(f["fresh"], np.uint8)
            worst = np.full(len(f), -np.inf, dtype=np.float32)
            worst[n >= degree] = sim[(np.cumsum(n) - 1)[n >= degree]]
            row = np.repeat(np.arange(len(f)), n)
            every = np.concatenate([np.arange(len(f)), row])
            yield pd.DataFrame({"to": np.concatenate([f["id"].to_numpy(), nbr]), "id": f["id"].to_numpy()[every], "code": f["code"].to_numpy()[every], "worst": worst[every],
                                "fresh": np.concatenate([np.zeros(len(f)), fresh]).astype(np.int32)})

    return run


def _adjacency(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ``to``: the ids and codes of the nodes next to a node, a few in a row, so that a batch of rows stays small."""
    for f in _whole_runs(frames, "to"):
        f = f[f["to"] != f["id"]]
        to = f["to"].to_numpy()
        place = np.arange(len(to)) - np.searchsorted(to, to, side="left")
        start = np.flatnonzero(place % TOGETHER == 0)
        ends = np.append(start[1:], len(to))
        raw, ids = list(f["code"]), f["id"].to_numpy()
        yield pd.DataFrame({"u": to[start], "nbr": [ids[a:b].tobytes() for a, b in zip(start, ends[:len(start)], strict=True)],
                            "codes": [b"".join(raw[a:b]) for a, b in zip(start, ends[:len(start)], strict=True)]})


def _sorted_by(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _messages(state: DataFrame, degree: int, with_far: bool = False) -> DataFrame:
    """to, id, code, worst, fresh: each node's code sent to itself, its neighbours and at most ``degree`` nodes that have it as theirs.

    The sample is taken per node by hash before the rows meet, so a node that everyone has as a neighbour is no large group."""
    edges = state.select("id", "nbr", "fresh").mapInPandas(_edges, "id long, other long, fresh int")
    few = Window.partitionBy("id").orderBy(F.desc("fresh"), F.xxhash64("other", "id"))
    edges = edges.withColumn("_rn", F.row_number().over(few)).where(F.col("_rn") <= degree)
    none = F.lit(None)
    both = state.select("id", "code", "nbr", "sim", F.col("fresh").alias("flags"), "far", none.cast("long").alias("other"), none.cast("int").alias("back")).union(
        edges.select("id", none.cast("binary"), none.cast("binary"), none.cast("binary"), none.cast("binary"), none.cast("binary"), "other", F.col("fresh")))
    return _sorted_by(both, "id").mapInPandas(_send(degree, with_far), "to long, id long, code binary, worst float, fresh int")


def neighbour_graph(codes: DataFrame, n: int, dim: int, degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES, seed: int = 7) -> tuple[DataFrame, str]:
    """The state of every node (id, code, nbr, sim, fresh, far, changed) after NN-descent, as a table in the shared folder and its path."""
    spark = codes.sparkSession
    parts = max(math.ceil(n / TREE_POINTS), min(spark.sparkContext.defaultParallelism, math.ceil(n / 4096)), 1)
    empty = F.lit(b"")
    rows = codes.select("id", "code", empty.alias("nbr"), empty.alias("sim"), empty.alias("fresh"), empty.alias("far"))
    for t in range(trees):
        direction = np.random.default_rng(seed + t).standard_normal(dim + 1).astype(np.float32)
        dealt = codes.mapInPandas(_along(direction), "id long, code binary, p float").repartitionByRange(parts, "p", "id").select("id", "code")
        mates = dealt.mapInPandas(_tree(degree, LEAF, seed + t), "id long, nbr binary, sim binary, fresh binary, far binary")
        rows = rows.union(mates.select("id", F.lit(None).cast("binary"), "nbr", "sim", "fresh", "far"))
    state, path = stage_path(_sorted_by(rows, "id").mapInPandas(_merge(degree), _STATE), "ann-graph")
    for turn in range(rounds):
        posted = state.select("id", "code", "nbr", "sim", "fresh").mapInPandas(_post(degree), "to long, id long, code binary, worst float, fresh int")
        # The limit applies per task before rows meet, so a node that all others have as a neighbour is no large group.
        few = Window.partitionBy("to").orderBy(F.desc("fresh"), F.xxhash64("id", "to", F.lit(turn)))
        here = posted.withColumn("_rn", F.row_number().over(few)).where(F.col("_rn") <= MEETING).drop("_rn")
        met = here.mapInPandas(_meet(PROPOSALS), "id long, nbr binary, sim binary, fresh binary")
        seen = F.unhex(F.repeat(F.lit("00"), F.octet_length("fresh")))  # all met in this round
        both = state.select("id", "code", "nbr", "sim", seen.alias("fresh"), "far").union(met.select("id", F.lit(None).cast("binary"), "nbr", "sim", "fresh", empty))
        nxt, nxt_path = stage_path(_sorted_by(both, "id").mapInPandas(_merge(degree), _STATE), "ann-graph")
        release(spark, path)
        state, path = nxt, nxt_path
        if (state.agg(F.sum("changed")).first()[0] or 0) < 0.01 * n * degree:
            break
    return state, path


# --- search ---------------------------------------------------------------------------------------------

_BEAM = "q long, code binary, ids binary, sims binary, opened binary, left long"


def _next(opened: np.ndarray, n: np.ndarray, n_open: int) -> np.ndarray:
    """Positions of each beam's first ``n_open`` nodes that are not yet opened (beams are sorted, best first)."""
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(opened == 0)
    r = row[at]
    return at[np.arange(len(r)) - np.searchsorted(r, r, side="left") < n_open]


def _frontier(n_open: int, beam: int):
    """The nodes that each beam opens next: u, q, code, worst."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, n = _flat(f["ids"], np.int64)
            sims, _ = _flat(f["sims"], np.float32)
            opened, _ = _flat(f["opened"], np.uint8)
            at = _next(opened, n, n_open)
            r = np.repeat(np.arange(len(f)), n)[at]
            worst = np.full(len(f), -2.0, dtype=np.float32)
            worst[n >= beam] = sims[(np.cumsum(n) - 1)[n >= beam]]
            yield pd.DataFrame({"u": ids[at], "q": f["q"].to_numpy()[r], "code": f["code"].to_numpy()[r], "worst": worst[r]})

    return run


def _score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Opened nodes with their adjacency to the nodes next to them that are better than the beam's worst: q, u, ids, sims."""
    for whole in frames:
        for a in range(0, len(whole), 2000):
            f = whole.iloc[a:a + 2000]
            ids, n = _flat(f["nbr"], np.int64)
            codes = np.frombuffer(b"".join(f["codes"]), dtype=np.uint8).reshape(len(ids), -1)
            query, row = decode_unit(_codes(f["code"])), np.repeat(np.arange(len(f)), n)
            sims = np.einsum("ij,ij->i", decode_unit(codes)[:, :-1], query[row, :-1])
            good = sims > f["worst"].to_numpy()[row]
            size = np.bincount(row[good], minlength=len(f))
            some = size > 0
            yield pd.DataFrame({"q": f["q"].to_numpy()[some], "ids": _packed(ids[good], size[some]), "sims": _packed(sims[good].astype(np.float32), size[some])})


def _advance(n_open: int, beam: int):
    """Runs of a query: its beam (with code) and what its opened nodes gave. Gives the new beam and how many of it are not opened."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_runs(frames, "q"):
            is_beam = f["code"].notna().to_numpy()
            f = pd.concat([f[is_beam], f[~is_beam]], ignore_index=True)
            qs, owner = np.unique(f["q"].to_numpy(), return_inverse=True)
            ids, n = _flat(f["ids"], np.int64)
            sims, _ = _flat(f["sims"], np.float32)
            old = f["opened"][:is_beam.sum()]
            opened, m = _flat(old, np.uint8)
            opened = opened.copy()
            opened[_next(opened, m, n_open)] = 1
            waits = np.ones(len(ids), dtype=np.int64)
            waits[:len(opened)] = 1 - opened.astype(np.int64)
            o, b, s, g = _best(owner[np.repeat(np.arange(len(f)), n)], ids, sims, waits, beam)
            size = np.bincount(o, minlength=len(qs))
            code = np.full(len(qs), None, dtype=object)
            code[owner[:len(old)]] = f["code"].to_numpy()[:len(old)]
            yield pd.DataFrame({"q": qs, "code": code, "ids": _packed(b, size), "sims": _packed(s.astype(np.float32), size), "opened": _packed((1 - g).astype(np.uint8), size),
                                "left": np.bincount(o, weights=g, minlength=len(qs)).astype(np.int64)})

    return run


def _first_beam(dim: int, entries: list[tuple[int, bytes]]):
    """Queries (q, rep, vec) to beams that hold the query's own node, if it has one, and the entry nodes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = decode_unit(_codes(pd.Series([c for _, c in entries])))
        names = np.array([i for i, _ in entries], dtype=np.int64)
        for f in frames:
            x = np.zeros((len(f), dim))
            for i, v in enumerate(f["vec"]):
                x[i, :len(v)] = v
            x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
            code = encode_unit(x)
            sims = decode_unit(code)[:, :-1] @ far[:, :-1].T
            rep = f["rep"].to_numpy(dtype="float64", na_value=np.nan) if f["rep"].isna().any() else f["rep"].to_numpy()
            out = []
            for i in range(len(f)):
                ids, s = names, sims[i]
                if not pd.isna(rep[i]):
                    other = names != int(rep[i])
                    ids, s = np.concatenate([[int(rep[i])], names[other]]), np.concatenate([[2.0], s[other]])
                o = np.lexsort((ids, -s))
                out.append((ids[o].astype(np.int64).tobytes(), s[o].astype(np.float32).tobytes(), bytes(len(o))))
            yield pd.DataFrame({"q": f["q"].to_numpy(), "code": [c.tobytes() for c in code], "ids": [a for a, _, _ in out], "sims": [b for _, b, _ in out], "opened": [c for _, _, c in out], "left": [len(c) for _, _, c in out]})

    return run


def _candidates(exact: int, k: int, dim: int):
    """The ``exact`` best nodes of each beam, and all others that the codes' rounding could hide from the ``k`` best."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids, n = _flat(f["ids"], np.int64)
            sims, _ = _flat(f["sims"], np.float32)
            row, start = np.repeat(np.arange(len(f)), n), np.cumsum(n) - n
            # The first node may be the query's own. Lengths are one at most, so a sum of ``dim`` products is off by less than dim + 2 roundings.
            last = sims[np.minimum(start + k, np.maximum(start + n - 1, 0))].astype(np.float64) if len(sims) else np.zeros(len(f))
            slack = 2.0 * (dim + 2) * float(np.finfo(np.float32).eps)
            at = np.flatnonzero((np.arange(len(row)) - start[row] < exact) | (sims >= last[row] - slack))
            yield pd.DataFrame({"q": f["q"].to_numpy()[row[at]], "rep": ids[at]})

    return run


def greedy_search(state: DataFrame, queries: DataFrame, dim: int, k: int, degree: int = DEGREE, beam: int = BEAM, exact: int = EXACT) -> DataFrame:
    """q, rep: the ``exact`` best nodes found for each query (q, rep, vec), by their codes, and those too close to the ``k`` best to tell. The result is a table in the shared folder."""
    spark = state.sparkSession
    entries = [(r["id"], bytes(r["code"])) for r in state.orderBy(F.xxhash64("id")).select("id", "code").limit(16).collect()]
    near = _sorted_by(_messages(state, degree, with_far=True), "to").mapInPandas(_adjacency, "u long, nbr binary, codes binary")
    name, where = f"ann_{uuid.uuid4().hex}", scratch_path(spark, "ann-adjacency")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    try:
        # Bucketed, so that the rounds join it without moving it again.
        near.write.format("parquet").bucketBy(buckets, "u").sortBy("u").option("path", where).saveAsTable(name)
        adjacency = spark.table(name)
        beams, path = stage_path(queries.mapInPandas(_first_beam(dim, entries), _BEAM), "ann-beam")
        for _ in range(SEARCH_ROUNDS):
            opened = beams.mapInPandas(_frontier(OPEN, beam), "u long, q long, code binary, worst float").join(adjacency, "u")
            found = opened.mapInPandas(_score, "q long, ids binary, sims binary")
            both = beams.select("q", "code", "ids", "sims", "opened").union(found.select("q", F.lit(None).cast("binary"), "ids", "sims", F.lit(b"")))
            nxt, nxt_path = stage_path(_sorted_by(both, "q").mapInPandas(_advance(OPEN, beam), _BEAM), "ann-beam")
            release(spark, path)
            beams, path = nxt, nxt_path
            waits, held = beams.agg(F.coalesce(F.sum("left"), F.lit(0)), F.coalesce(F.sum(F.octet_length("opened")), F.lit(0))).first()
            if waits <= UNOPENED * held:
                break
        out, _ = stage_path(beams.mapInPandas(_candidates(exact, k, dim), "q long, rep long"), "ann-found")
        release(spark, path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(spark, where)
    return out


def inner_product(a: str, b: str) -> Column:
    """In double precision; the longer array's rest counts as zeros."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that ``is_query`` (over column ``id``) marks, the ``k`` other rows of largest inner product found."""
    spark = rows.sparkSession
    base, _ = stage_path(clean_vectors(rows, key, vec), "ann-vectors")
    dim, n, norm = base.agg(F.max(F.size("vec")), F.count(F.lit(1)), F.max(F.sqrt(inner_product("vec", "vec")))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    nodes, _ = stage_path(base.groupBy("vec").agg(F.min("id").alias("rep")), "ann-nodes")
    codes, codes_path = stage_path(nodes.select(F.col("rep").alias("id"), "vec").mapInPandas(_unit(dim, norm), "id long, code binary"), "ann-codes")
    state, path = neighbour_graph(codes, codes.count(), dim)
    queries, _ = stage_path(base.where(is_query).join(nodes, "vec").select(F.col("id").alias("q"), "rep", "vec"), "ann-queries")
    found = greedy_search(state, queries, dim, k)
    release(spark, path, codes_path)
    # Of equal vectors the k + 1 smallest ids suffice, as one may be the query's own; the limit applies before rows meet.
    some = base.withColumn("_rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_rn") <= k + 1)
    members = some.join(nodes, "vec").select("rep", F.col("id").alias("vec_id"), F.col("vec").alias("v"))
    scored = (found.join(members, "rep").where("vec_id <> q").join(queries.select("q", "vec"), "q")
              .select(F.col("q").alias("query_id"), "vec_id", inner_product("vec", "v").alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row of ``embeddings`` whose id is divisible by 20, among all other rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0, 20)
