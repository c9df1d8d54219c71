"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Vectors are dealt to cells around at most CELLS centres, which are fitted on a bounded sample;
a cell is a shard, or several where it holds more than SHARD vectors.  In every shard a graph
joins each vector to K near ones.  It starts from those in the same leaf of a few random trees;
then, round by round, a Spark join brings together each vector's neighbours and the vectors whose neighbour
it is (capped at K of these), and any two that meet at a vector become neighbours if each
other's lists improve.  All shards do a round at once, as one job; a round shuffles the lists
and the vectors, not the pairs.

A query visits the cells whose centres are nearest.  How many is measured, not set: TRIED
queries are answered exactly, by one pass over all vectors, and the least number of cells is
taken that hold COVER of their true neighbours.  Vectors in clusters need few cells however
many there are; vectors without structure need most of them, and the work of all queries then
grows with their number times that of the vectors.

In each shard a query walks the graph from its own node, ENTRIES places and places in every
connected part to the best unvisited neighbours until the BEAM best found are all expanded; a
step costs what it expands, whatever the shard's size.  Scores are exact inner products in
double precision; the shards' lists are merged.  Nearness by largest inner product becomes a
distance by an extra coordinate that gives all vectors one norm, so the graph suits vectors of
any norms.

Copies (equal vectors) stand in the graph once and are put back at the end: a query's result
can hold at most its first ``k + 1`` of each.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids; ties go to the smaller vec_id; with fewer
candidates than ``k`` all are found; repeated ids count once, with the
least of their vectors; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import saved, table

#: Vectors in a shard and queries in a block of a shard, about; cells at most.
SHARD, BLOCK, CELLS = 16384, 4096, 1024
#: Vectors that the centres are fitted on; steps of the fit.
SAMPLE, FIT = 20_000, 8
#: Queries that the number of cells to visit is measured with, and the share of their neighbours to cover.
TRIED, COVER = 256, 0.98
#: Neighbours of a vector in the graph; rounds of NN-descent.
K, ROUNDS = 20, 5
#: Random trees that the first neighbours come from, and vectors in a leaf.
TREES, LEAF = 6, 48
#: Where a search begins, how many of the best it expands, how many at a time.
ENTRIES, BEAM, STEP = 64, 160, 8
#: Nodes of a connected part of the graph for each further beginning there.
PER_ENTRY = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return v.filter(F.size("embedding") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _merge(n: int, u, v, s, k: int):
    """The k best distinct v of each u; (u, v, s) in that order."""
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    pair = u * n + v
    first = np.zeros(len(u), bool)
    first[np.unique(pair, return_index=True)[1]] = True
    u, v, s = u[first], v[first], s[first]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    return u[rank < k], v[rank < k], s[rank < k]


def _leaves(x: np.ndarray, rng) -> list[np.ndarray]:
    """Parts of LEAF vectors at most: halved again and again along the line through two random ones."""
    todo, done = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            done.append(part)
            continue
        a, b = rng.choice(part, 2, replace=False)
        order = part[np.argsort(x[part] @ (x[a] - x[b]), kind="stable")]
        todo += [order[: len(part) // 2], order[len(part) // 2 :]]
    return done


def _descend(key, vectors: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """One round in a shard.  lists: center, members, fresh (bits of members new since last time)."""
    ids = np.sort(vectors["rep"].to_numpy())
    n = len(ids)
    x = np.zeros((n, len(vectors["vector"].iat[0])), np.float32) if n else np.zeros((0, 1), np.float32)
    x[np.searchsorted(ids, vectors["rep"].to_numpy())] = _matrix(vectors["vector"])
    us, vs, ss = [], [], []
    if len(lists):
        width = max(len(m) for m in lists["members"])
        member = np.full((len(lists), width), -1)
        fresh, own = np.zeros((len(lists), width), bool), np.zeros((len(lists), width), bool)
        for r, (m, f, o) in enumerate(zip(lists["members"], lists["fresh"], lists["own"])):
            member[r, : len(m)], fresh[r, : len(m)], own[r, : len(m)] = np.searchsorted(ids, m), f, o
        center = np.searchsorted(ids, lists["center"].to_numpy())
        # the lists so far: what a center has of its own
        r, c = np.nonzero(own)
        u, v = center[r], member[r, c]
        s = np.einsum("ij,ij->i", x[u], x[v])
        us, vs, ss = [u], [v], [s]
        worst = np.full(n, np.inf, np.float32)
        np.minimum.at(worst, u, s)
        worst[np.bincount(u, minlength=n) < min(K, n - 1)] = -np.inf
        for b in range(0, len(lists), 256):
            m, f = member[b : b + 256], fresh[b : b + 256]
            y = x[m]
            score = y @ y.transpose(0, 2, 1)
            ok = (f[:, :, None] | f[:, None, :]) & (m[:, :, None] >= 0) & (m[:, None, :] >= 0) & (score > worst[m][:, :, None])
            ok &= m[:, :, None] != m[:, None, :]
            g, i, j = np.nonzero(ok)
            us.append(m[g, i])
            vs.append(m[g, j])
            ss.append(score[g, i, j])
    else:  # the first lists: what falls into a leaf of a random tree with a vector
        rng = np.random.default_rng(int(ids[0]) & 0xFFFF if n else 0)
        for leaf in (leaf for _ in range(TREES) for leaf in _leaves(x, rng)) if n > 1 else ():
            score = x[leaf] @ x[leaf].T
            i, j = np.nonzero(~np.eye(len(leaf), dtype=bool))
            us.append(leaf[i])
            vs.append(leaf[j])
            ss.append(score[i, j])
    if not us:
        return pd.DataFrame({"shard": [], "u": [], "v": [], "fresh": []})
    old = set()
    if len(lists):
        old = us[0] * n + vs[0]
    u, v, _ = _merge(n, np.concatenate(us), np.concatenate(vs), np.concatenate(ss), K)
    fresh = ~np.isin(u * n + v, old) if len(lists) else np.ones(len(u), bool)
    return pd.DataFrame({"shard": np.full(len(u), key[0]), "u": ids[u], "v": ids[v], "fresh": fresh})


def neighbour_graph(points: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """shard, u, v, fresh: the K neighbours of each point (shard, rep, vector)."""
    schema = "shard int, u long, v long, fresh boolean"
    spark = points.sparkSession
    lists = spark.createDataFrame([], "shard int, center long, members array<long>, fresh array<boolean>, own array<boolean>")
    by_shard = points.groupBy("shard")
    edges = None
    for _ in range(rounds + 1):
        if edges is not None:
            # what meets at a point: its neighbours, and the points whose neighbour it is
            back = edges.select("shard", F.col("v").alias("center"), F.col("u").alias("member"), "fresh")
            some = Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("member", "center"))
            back = back.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= K).select("shard", "center", "member", "fresh", F.lit(False).alias("own"))
            ahead = edges.select("shard", F.col("u").alias("center"), F.col("v").alias("member"), "fresh", F.lit(True).alias("own"))
            met = ahead.unionByName(back).groupBy("shard", "center", "member").agg(F.max("fresh").alias("fresh"), F.max("own").alias("own"))
            lists = met.groupBy("shard", "center").agg(F.array_sort(F.collect_list(F.struct("member", "fresh", "own"))).alias("m")).select(
                "shard", "center", F.col("m.member").alias("members"), F.col("m.fresh").alias("fresh"), F.col("m.own").alias("own"))
        edges = saved(by_shard.cogroup(lists.groupBy("shard")).applyInPandas(_descend, schema))
    return edges


def _parts(near: np.ndarray) -> np.ndarray:
    """The least node of each node's connected part, links taken both ways; ``near`` is padded with -1."""
    a, c = np.nonzero(near >= 0)
    b, label = near[a, c], np.arange(len(near))
    while True:
        last = label.copy()
        np.minimum.at(label, a, last[b])
        np.minimum.at(label, b, last[a])
        label = label[label]
        if (label == last).all():
            return label


def _entries(near: np.ndarray) -> np.ndarray:
    """ENTRIES places all over the shard, and in each part of the graph one place for PER_ENTRY nodes, one at least."""
    n, label = len(near), _parts(near)
    order = np.argsort(label, kind="stable")
    rank = np.arange(n) - np.searchsorted(label[order], label[order])
    return np.union1d(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int), order[rank % PER_ENTRY == 0])


class Walk:
    """Greedy search of one shard for some queries at once."""

    def __init__(self, x: np.ndarray, near: np.ndarray, z: np.ndarray, own: np.ndarray, beam: int = 0):
        """``near`` is padded with -1; ``own`` is each query's node, or -1."""
        self.x, self.near, self.z = x, near, z
        m, n = len(z), len(x)
        self.seen = np.zeros((m, n), bool)
        beam = min(n, beam or BEAM)
        self.score, self.node = np.full((m, beam), -np.inf), np.full((m, beam), -1)
        self.open = np.zeros((m, beam), bool)
        entries = _entries(near)
        self.meet(np.arange(m), np.concatenate([np.broadcast_to(entries, (m, len(entries))), own[:, None]], axis=1))
        while self.step():
            pass

    def step(self) -> bool:
        """Expands the STEP best nodes of each beam that are open; whether there were any."""
        value = np.where(self.open, self.score, -np.inf)
        active = np.flatnonzero(self.open.any(axis=1))
        if not len(active):
            return False
        pick = np.argsort(-value[active], axis=1, kind="stable")[:, :STEP]
        good = np.take_along_axis(self.open[active], pick, 1)
        self.open[active[:, None], pick] = False
        nodes = self.near[np.take_along_axis(self.node[active], pick, 1)]
        nodes[~good] = -1
        self.meet(active, nodes.reshape(len(active), -1))
        return True

    def meet(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Scores the nodes (one line for each of ``rows``) that are new and puts them into the beams."""
        nodes = np.sort(nodes, axis=1)
        new = nodes >= 0
        new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        r, c = np.nonzero(new)
        fresh = ~self.seen[rows[r], nodes[r, c]]
        r, c = r[fresh], c[fresh]
        self.seen[rows[r], nodes[r, c]] = True
        score = np.full(nodes.shape, -np.inf)
        for a in range(0, len(r), 65536):
            i, j = r[a : a + 65536], c[a : a + 65536]
            score[i, j] = np.einsum("ij,ij->i", self.z[rows[i]], self.x[nodes[i, j]])
        score = np.concatenate([self.score[rows], score], axis=1)
        node = np.concatenate([self.node[rows], nodes], axis=1)
        open_ = np.concatenate([self.open[rows], np.ones(nodes.shape, bool)], axis=1)
        best = np.argsort(-score, axis=1, kind="stable")[:, : self.score.shape[1]]
        self.score[rows], self.node[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(node, best, 1)
        self.open[rows] = np.take_along_axis(open_, best, 1) & (self.score[rows] > -np.inf)


def _search(k: int):
    def run(key, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(graph["rep"].to_numpy())
        n, q = len(ids), len(queries)
        if not n or not q:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "scored": pd.Series(dtype="int64")})
        place = np.searchsorted(ids, graph["rep"].to_numpy())
        x = np.zeros((n, len(graph["embedding"].iat[0])))
        x[place] = _matrix(graph["embedding"])
        width = max(1, max(len(m) for m in graph["near"]))
        near = np.full((n, width), -1)
        for p, m in zip(place, graph["near"]):
            near[p, : len(m)] = np.searchsorted(ids, m)
        y, asked = _matrix(queries["embedding"]), queries["query"].to_numpy()
        own = np.minimum(np.searchsorted(ids, asked), n - 1)
        own = np.where(ids[own] == asked, own, -1)
        out = []
        for b in range(0, q, 128):
            walk = Walk(x, near, y[b : b + 128], own[b : b + 128], max(BEAM, k))
            ok = walk.score[:, :k] > -np.inf
            met = np.zeros(ok.shape, np.int64)
            met[:, 0] = walk.seen.sum(axis=1)  # once for each query
            out.append((np.repeat(asked[b : b + 128], ok.sum(axis=1)), ids[walk.node[:, :k][ok]], walk.score[:, :k][ok], met[ok]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query", "rep", "score", "scored"), zip(*out))})

    return run


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the sample's vectors, by a few rounds of k-means from every so many-th of them."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(FIT):
        cell = _near(sample, c).argmax(axis=1)
        n = np.bincount(cell, minlength=cells)
        total = np.zeros_like(c)
        np.add.at(total, cell, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Larger for a nearer centre."""
    return x @ c.T - (c * c).sum(axis=1) / 2


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Where the best neighbours of queries would lie: on the sphere of all vectors, without the extra coordinate."""
    length = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)
    return np.concatenate([x * (norm / length)[:, None], np.zeros((len(x), 1))], axis=1)


def in_cells(points: DataFrame, c: np.ndarray) -> DataFrame:
    """rep, embedding, vector and the cell of each point."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(cell=_near(_matrix(pdf["vector"]), c).argmax(axis=1).astype(np.int32))

    return points.select("rep", "embedding", "vector").mapInPandas(run, "rep long, embedding array<double>, vector array<double>, cell int")


def cells_to_visit(points: DataFrame, tried: pd.DataFrame, c: np.ndarray, norm: float, k: int) -> int:
    """How many of the nearest cells hold COVER of the true neighbours of the tried queries (rep, embedding)."""
    y, own = _matrix(tried["embedding"]), tried["rep"].to_numpy()
    if not len(y) or len(c) == 1:
        return len(c)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                s = y @ _matrix(pdf["embedding"]).T
                s[own[:, None] == pdf["rep"].to_numpy()[None]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(y)), top.shape[1]), "rep": pdf["rep"].to_numpy()[top].ravel(),
                                    "cell": pdf["cell"].to_numpy()[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = (points.select("rep", "embedding", "cell").mapInPandas(run, "q long, rep long, cell int, score double")
             .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "cell").toPandas())  # TRIED * k rows at most
    order = np.argsort(-_near(_lifted(y, norm), c), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(c)), order.shape), axis=1)
    held = np.cumsum(np.bincount(rank[found["q"], found["cell"]], minlength=len(c)))
    return int(np.searchsorted(held, COVER * held[-1])) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query; and scored, the vectors that it met."""
    v = usable(vectors)
    copies = v.groupBy("embedding").agg(F.min("vec_id").alias("rep"))
    first = Window.partitionBy("rep").orderBy("vec_id")
    named = saved(v.join(copies, "embedding").select("vec_id", "rep", F.when(F.col("vec_id") == F.col("rep"), F.col("embedding")).alias("embedding")))
    members = named.select("vec_id", "rep").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("rep", "vec_id")
    own = named.filter("embedding is not null")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    norms = own.agg(F.count("*").alias("n"), F.max(square).alias("most")).head()
    most = norms["most"] or 0.0
    lifted = own.select("rep", "embedding", F.concat("embedding", F.array(F.sqrt(F.greatest(F.lit(0.0), F.lit(most) - square)))).alias("vector"))
    cells = min(CELLS, max(1, -(-norms["n"] // SHARD)))
    sample = lifted.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas() if cells > 1 else pd.DataFrame({"vector": [np.zeros(1)]})
    c = centres(_matrix(sample["vector"]), cells) if cells > 1 else None
    placed = saved(in_cells(lifted, c) if cells > 1 else lifted.withColumn("cell", F.lit(0)))
    # shards of a cell follow each other; at most CELLS numbers
    size = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = np.array([max(1, round(size.get(i, 0) / SHARD)) for i in range(cells)])
    at = np.concatenate([[0], np.cumsum(parts)])
    table_ = placed.sparkSession.createDataFrame([(i, int(at[i]), int(parts[i])) for i in range(cells)], "cell int, at int, parts int")
    points = saved(placed.join(F.broadcast(table_), "cell").withColumn("shard", (F.col("at") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")).select("shard", "rep", "embedding", "vector"))
    edges = neighbour_graph(points.select("shard", "rep", "vector"))

    both = edges.select("shard", F.col("u").alias("rep"), F.col("v").alias("near")).unionByName(
        edges.select("shard", F.col("v").alias("rep"), F.col("u").alias("near"), F.xxhash64("u", "v").alias("h"))
        .withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("h"))).filter(F.col("r") <= K).select("shard", "rep", "near"))
    near = both.groupBy("rep").agg(F.array_sort(F.collect_set("near")).alias("near"))
    graph = points.join(near, "rep", "left").select("shard", "rep", "embedding", F.coalesce("near", F.array().cast("array<long>")).alias("near"))

    asked = named.filter(is_query).select(F.col("vec_id").alias("query_id"), "rep")
    queries = asked.select("rep").distinct().join(points.select("rep", "embedding"), "rep")
    if cells > 1:
        tried = queries.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(TRIED).toPandas()
        visits = cells_to_visit(placed, tried, c, most**0.5, k)

        def route(batches):
            for pdf in batches:
                if len(pdf):
                    order = np.argsort(-_near(_lifted(_matrix(pdf["embedding"]), most**0.5), c), axis=1, kind="stable")[:, :visits]
                    yield pdf.assign(shard=[[int(j) for i in line for j in range(at[i], at[i + 1])] for line in order])

        queries = queries.mapInPandas(route, "rep long, embedding array<double>, shard array<int>").select("rep", "embedding", F.explode("shard").alias("shard"))
    else:
        queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(int(at[-1]) - 1))))
    queries = saved(queries.withColumnRenamed("rep", "query"))
    # a shard with many queries meets them in blocks
    blocks = queries.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    queries = queries.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
    graph = graph.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = saved(graph.select("shard", "block", "rep", "embedding", "near").groupBy("shard", "block").cogroup(
        queries.select("shard", "block", "query", "embedding").groupBy("shard", "block")).applyInPandas(_search(k + 1), "query long, rep long, score double, scored long"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = (found.withColumn("scored", F.sum("scored").over(Window.partitionBy("query")))
            .withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k + 1).select("query", "rep", "score", "scored"))
    rows = (best.join(members, "rep").select(F.col("query").alias("rep"), "vec_id", "score", "scored")
            .join(asked, "rep").filter("vec_id <> query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("scored")
