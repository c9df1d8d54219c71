"""An n-gram Jaccard self-join by R-trees over count vectors.

A text's set of 5-word shingles is hashed into groups; the counts of the groups are its
point.  Larger sets have more groups, by powers of two, so unrelated texts stay apart at every
length; a point is folded in half to be compared with one of half as many groups.  For two
sets, the sum of the coordinates' minima bounds the overlap from above, and so does the sum
over the upper corners of two boxes of points.  An R-tree over the points, walked against
itself from its root, therefore finds all pairs whose bound reaches what the similarity asks
for; the surviving pairs are verified on the whole sets.

One tree over all texts prunes little but by size (counts of unrelated texts of one size lie
close together in many dimensions, so boxes of them overlap; README has figures) and would
compare a share of all pairs.  So the subtrees of the top level are formed by shingle: of a
set, only the part that must hold a common member of any similar set is indexed (a fifth of
it, the shingles that a bounded sample found frequent last), and each indexed shingle has a
tree of its own.

* A tree yields no pairs, but a spanning forest of its bound graph: texts that are joined
  already need no more pairs.  What it emits grows with its members, not with their square.
* The components of these forests are families; two similar texts share one.  A family is
  verified exactly, where it lies, again up to a spanning forest, and its components are
  the answer.
* Trees of more than TREE members and families of more than FAMILY are dealt out in blocks
  (``clusters``); no pair is left out.
* Copies (equal sets) take part once, by a 128-bit sum of their shingles.

Defined results: texts without words, and null texts, have an empty set and link with
nothing; a text with fewer than 5 words has one shingle, of all of them; a text of any length
is compared whole; repeated rows (equal doc_id too) give one result each; a null doc_id gets
no component and hides no copies of its text; similarity at the limit links; an empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .graph import components
from .hashing import WIDTH, chunks, distinct, mix, shingles
from .shared import narrowed, saved, table

#: Two sets are similar when 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Coordinates of a point at least, and shingles per coordinate at most.
GROUPS, PER_GROUP = 32, 4
#: Members of a leaf of a tree, of a block of a tree and of a block of a family.
LEAF, TREE, FAMILY = 16, 1024, 1024
#: Texts that frequent shingles are learnt from, about, and the texts that hold a frequent one.
SAMPLE, FREQUENT = 6000, 4
#: Parts that the copies of one set are dealt to.
SALTS = 32


def least_overlap(a, b):
    """The overlap that similar sets of these sizes have at least."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        """Each joined number but the least of its part, with that: stars, which are put together in few steps."""
        return [(r, x) for x in range(len(self.up)) if (r := self.find(x)) != x]


def groups(n):
    """Coordinates of the points of sets of n."""
    return np.maximum(GROUPS, 1 << np.ceil(np.log2(np.maximum(n, 1) / PER_GROUP)).clip(0).astype(np.int64))


def fold(point: np.ndarray, width: int) -> np.ndarray:
    """The point of the same set with fewer groups."""
    return point.reshape(-1, width).sum(axis=0)


def tree_join(size: np.ndarray, points: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join all pairs whose bound reaches the least overlap, by a tree for each width of points.

    ``side``: if given, only pairs of different sides count.
    """
    width = np.array([len(p) for p in points])
    edges = []
    if side is not None and (side == side[0]).all():
        return edges
    for g in np.unique(width):
        # the sets of this width, and those of the next that are within reach of them
        near = (width == g) | ((width == 2 * g) & (size * PERCENT <= size[width == g].max() * 100))
        pick = np.flatnonzero(near)
        if len(pick) > 1:
            tree = Tree(size[pick], np.stack([fold(points[k], g) for k in pick]))
            edges += [(int(pick[a]), int(pick[b])) for a, b in tree.joined(side[pick] if side is not None else None)]
    return edges


class Tree:
    """An R-tree over points of one width, bulk-loaded in order of size and counts.

    ``levels`` go from the points to the root.  A level has for each node its least and largest
    size and the lower and upper corner of its box; node k's children are the LEAF nodes of the
    level below that begin with k * LEAF.
    """

    def __init__(self, size: np.ndarray, point: np.ndarray):
        self.order = np.lexsort((point[:, 1 % point.shape[1]], point[:, 0], size))
        size, point = size[self.order].astype(np.int64), point[self.order].astype(np.int64)
        self.levels = [(size, size, point, point)]
        while len(self.levels[-1][0]) > 1:
            low, high, bottom, top = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.minimum.reduceat(bottom, at, axis=0), np.maximum.reduceat(top, at, axis=0)))
        self.tested = 0

    def within(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of a level's nodes can hold a pair whose overlap is large enough."""
        low, high, bottom, top = self.levels[level]
        ok = (low[a] * PERCENT <= high[b] * 100) & (low[b] * PERCENT <= high[a] * 100)
        near = np.flatnonzero(ok)
        self.tested += len(near)
        step = max(1, 4_000_000 // top.shape[1])
        for k in range(0, len(near), step):
            n = near[k : k + step]
            x, y = a[n], b[n]
            bound = np.minimum(top[x], top[y]).sum(axis=1)
            if level:  # what one box has beyond the other's upper corner can't be shared either
                bound = np.minimum(bound, high[x] - np.maximum(bottom[x] - top[y], 0).sum(axis=1))
                bound = np.minimum(bound, high[y] - np.maximum(bottom[y] - top[x], 0).sum(axis=1))
            ok[n] = bound >= least_overlap(low[x], low[y])
        return ok

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that the walk of the tree against itself comes to."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 2, 0, -1):
            n = len(self.levels[level][0])
            i, j = np.divmod(np.arange(LEAF * LEAF), LEAF)
            a, b = (a[:, None] * LEAF + i).ravel(), (b[:, None] * LEAF + j).ravel()
            real = (a <= b) & (b < n)
            a, b = a[real], b[real]
            ok = self.within(level, a, b)
            a, b = a[ok], b[ok]
        return a, b

    def joined(self, side: np.ndarray | None) -> list[tuple[int, int]]:
        """A spanning forest of the pairs of points whose bound reaches the least overlap."""
        size, _, _, point = self.levels[0]
        n = len(size)
        side = side[self.order] if side is not None else None
        forest, root = Forest(n), np.arange(n)
        for x, y in zip(*self.leaves()):
            a0, b0 = x * LEAF, y * LEAF
            a1, b1 = min(n, a0 + LEAF), min(n, b0 + LEAF)
            if (root[a0:a1] == root[a0]).all() and (root[b0:b1] == root[a0]).all():
                continue  # all joined already
            bound = np.minimum(point[a0:a1, None], point[None, b0:b1]).sum(axis=2)
            self.tested += bound.size
            ok = bound >= least_overlap(size[a0:a1, None], size[None, b0:b1])
            ok &= root[a0:a1, None] != root[None, b0:b1]
            if side is not None:
                ok &= side[a0:a1, None] != side[None, b0:b1]
            if x == y:
                ok = np.triu(ok, 1)
            found = np.argwhere(ok)
            if len(found):
                for i, j in found:
                    forest.join(int(a0 + i), int(b0 + j))
                root = _refresh(forest, root, found, a0, b0)
        return [(int(self.order[a]), int(self.order[b])) for a, b in forest.edges()]


def _refresh(forest: Forest, root: np.ndarray, found: np.ndarray, a0: int, b0: int) -> np.ndarray:
    """``root`` after joins, relabelled only where a label changed."""
    for x in np.unique(np.concatenate([root[a0 + found[:, 0]], root[b0 + found[:, 1]]])):
        now = forest.find(int(x))
        if now != x:
            root[root == x] = now
    return root


def shapes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, k1, k2 (of the set), point, and the indexed shingles of the first copy a task sees."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        seen = set()
        for batch in batches:
            for i, j, w in chunks(batch.column(1)):
                rows = j - i
                owner, keys = distinct(*shingles(w))
                n = np.bincount(owner, minlength=rows)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for seed in (11, 12):
                    run_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys, seed))])
                    sums.append((run_[at[1:]] - run_[at[:-1]]).view(np.int64))
                wide = groups(n)
                base = np.concatenate([[0], np.cumsum(wide)])
                point = np.bincount(base[owner] + ((keys >> np.uint64(32)).astype(np.int64) & (wide[owner] - 1)), minlength=base[-1]).astype(np.uint16)
                # frequent shingles last, else by hash: the order only has to be the same everywhere
                late = np.isin(keys, frequent) if len(frequent) else np.zeros(len(keys), bool)
                by = np.lexsort((keys, late, owner))
                place = np.arange(len(keys)) - at[owner]
                named = batch.column(0).slice(i, rows).is_valid().to_numpy(zero_copy_only=False)  # others have no index
                new = np.array([n[r] > 0 and named[r] and (k := (sums[0][r], sums[1][r])) not in seen and not seen.add(k) for r in range(rows)], bool)
                index = by[(place < index_size(n)[owner]) & new[owner[by]]]
                m = np.where(new, index_size(n), 0)
                ends = np.concatenate([[0], np.cumsum(m)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, rows), pa.array(n), pa.array(sums[0]), pa.array(sums[1]),
                    pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((2 * base).astype(np.int32)), pa.py_buffer(point)]),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[index].view(np.int64))),
                ], ["doc_id", "n", "k1", "k2", "point", "index"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {key}, n long, k1 long, k2 long, point binary, index array<long>")


def index_size(n):
    """Of a set of n, so many members in a fixed order hold one of any similar set."""
    return np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)


def frequent_shingles(docs: DataFrame, sample: int = SAMPLE, least: int = FREQUENT) -> np.ndarray:
    """Shingles that at least ``least`` of a bounded sample of texts hold, sorted.

    Any list gives the same result; a good one keeps passages that many texts share out of the index.
    """
    def run(batches):
        for batch in batches:
            for _, _, w in chunks(batch.column(0)):
                keys, n = np.unique(distinct(*shingles(w))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["k", "n"])

    some = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h"))
    n = docs.count()
    some = some.filter(F.pmod("h", F.lit(max(1, n // sample))) == 0).select("text")
    got = (some.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
           .filter(F.col("n") >= least).orderBy(F.desc("n"), "k").limit(200_000).select("k").toArrow())
    return np.sort(got.column("k").to_numpy().view(np.uint64))


def clusters(rows: DataFrame, key: str, most: int, largest: int, attach, run, order: list[str]) -> DataFrame:
    """id, component: what a relation joins, directly or over others, in the groups of ``rows`` (key, rep, members).

    ``attach`` joins to rows what ``run`` needs; ``run`` gets them ordered by key, i and j, and
    gives edges that join all pairs of the relation.  A group of more than ``most`` members is
    dealt out in blocks.  First each block works alone.  What it joins is one part from then on,
    and of each part one member meets those of other parts.  Parts that are still apart are
    compared whole, block by block; so rows are copied to other blocks only in groups that are no
    family at all, or of more than one.
    """
    parts = F.ceil(F.col("members") / most).cast("int")
    block = F.pmod(F.xxhash64("rep"), parts).cast("int")

    def edges(dealt: DataFrame) -> DataFrame:
        ordered = attach(dealt.drop("members")).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", *order)
        return ordered.mapInArrow(run, "a long, b long")

    def crossed(df: DataFrame, least: int) -> DataFrame:
        """Each row once for each pair of blocks, ``least`` apart or more, that it takes part in."""
        both = df.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = both.filter(F.abs(F.col("own") - F.col("other")) >= least)
        return both.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")

    def labelled(part: DataFrame) -> DataFrame:
        """The large groups' rows with the part that each is in, as ``side``."""
        label = part.select(F.col("id").alias("rep"), "component")
        return saved(rows.filter(F.col("members") > most).join(label, "rep", "left").withColumn("side", F.coalesce("component", "rep")).drop("component"))

    def merged(part: DataFrame, more: DataFrame) -> DataFrame:
        """The parts, put together where ``more`` edges join members of them."""
        label = lambda name: part.select(F.col("id").alias(name), F.col("component").alias(f"of_{name}"))
        joins = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        of = components(joins).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        old = part.join(of, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
        new = of.select(F.col("component").alias("id"), F.col("whole").alias("component"))  # members of no part until now, and heads
        return saved(old.union(new).groupBy("id").agg(F.min("component").alias("component")))

    part = saved(components(edges(rows.withColumn("i", block).withColumn("j", F.col("i")).withColumn("side", F.lit(0).cast("long")))))
    if largest <= most:
        return part
    now = labelled(part)
    # by a hash of both, so that groups of the same members take different heads
    heads = now.groupBy(key, "side").agg(F.min_by("rep", F.xxhash64("rep", key)).alias("rep"))
    heads = heads.join(heads.groupBy(key).agg(F.count("*").alias("members")).filter("members > 1"), key)
    heads = saved(now.drop("members").join(heads, [key, "side", "rep"]))
    if heads.isEmpty():
        return part
    part = merged(part, edges(crossed(heads, 0)))
    now = labelled(part)
    apart = now.groupBy(key).agg(F.min("side").alias("x"), F.max("side").alias("y")).filter("x <> y").select(key)
    apart = saved(now.join(apart, key, "left_semi"))
    return part if apart.isEmpty() else merged(part, edges(crossed(apart, 1)))


def _groups(batches, names):
    """(arrays of one group) of rows that come ordered by ``names``; groups go on over batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        if t.num_rows == 0:
            continue
        new = np.zeros(t.num_rows, bool)
        for c in names:
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(new)
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield t.slice(0, last).combine_chunks(), np.concatenate([[0], cuts])
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _points(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in column.combine_chunks()]


def _forests(batches):
    """Edges of the bound graph's spanning forest of each tree."""
    for t, cuts in _groups(batches, ["shingle", "i", "j"]):
        rep, n, point = t.column("rep").to_numpy(), t.column("n").to_numpy(), _points(t.column("point"))
        side, cross = t.column("side").to_numpy(), t.column("i").to_numpy() != t.column("j").to_numpy()
        size = np.diff(cuts)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in cuts[:-1][size == 2]:  # most trees have two members
            g = min(len(point[s]), len(point[s + 1]))
            if np.minimum(fold(point[s], g), fold(point[s + 1], g)).sum() >= least_overlap(n[s], n[s + 1]):
                a.append(rep[s : s + 1])
                b.append(rep[s + 1 : s + 2])
        for s, e in zip(cuts[:-1][size > 2], cuts[1:][size > 2]):
            if edges := tree_join(n[s:e], point[s:e], side[s:e] if cross[s] else None):
                x = np.array(edges) + s
                a.append(rep[x[:, 0]])
                b.append(rep[x[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def verified(sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs, by exact overlaps."""
    n = len(sets)
    order = np.argsort(sizes, kind="stable")
    forest = Forest(n)
    if side is not None and (side == side[0]).all():
        return []
    held = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, int)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ids = [held[ends[k] : ends[k + 1]] for k in range(n)]
    if n <= 8:
        for x in range(n):
            for y in range(x + 1, n):
                if forest.find(x) != forest.find(y) and (side is None or side[x] != side[y]):
                    both = len(np.intersect1d(ids[x], ids[y], assume_unique=True))
                    if 100 * both >= PERCENT * (len(ids[x]) + len(ids[y]) - both):
                        forest.join(x, y)
        return forest.edges()
    # members that two or more hold, as columns of a 0/1 matrix, a strip of rows at a time
    count = np.bincount(held)
    column = np.cumsum(count > 1) - 1
    shared = [column[i[count[i] > 1]] for i in ids]
    width = int(column[-1]) + 1 if len(column) else 0
    length = np.array([len(i) for i in ids])
    strip = max(1, min(n, 8_000_000 // max(1, width)))
    for lo in range(0, n, strip):
        rows = order[lo : lo + strip]
        left = np.zeros((len(rows), width), np.float32)
        for r, k in enumerate(rows):
            left[r, shared[k]] = 1
        for lo2 in range(lo, n, strip):
            cols = order[lo2 : lo2 + strip]
            if length[cols[0]] * PERCENT > length[rows[-1]] * 100:
                break  # too long for any of the rows
            right = left if lo2 == lo else np.zeros((len(cols), width), np.float32)
            if lo2 != lo:
                for r, k in enumerate(cols):
                    right[r, shared[k]] = 1
            both = left @ right.T
            ok = 100 * both >= PERCENT * (length[rows][:, None] + length[cols][None] - both)
            if side is not None:
                ok &= side[rows][:, None] != side[cols][None]
            for x, y in np.argwhere(np.triu(ok, 1) if lo2 == lo else ok):
                forest.join(int(rows[x]), int(cols[y]))
    return forest.edges()


def _links(batches):
    """Edges of a spanning forest of each family's similar pairs."""
    for t, cuts in _groups(batches, ["family", "i", "j"]):
        rep, text = t.column("rep").to_numpy(), t.column("text").combine_chunks()
        side, cross = t.column("side").to_numpy(), t.column("i").to_numpy() != t.column("j").to_numpy()
        sets: list[np.ndarray] = []
        for i, j, w in chunks(text):
            owner, keys = distinct(*shingles(w))
            at = np.searchsorted(owner, np.arange(j - i + 1))
            sets += [keys[at[r] : at[r + 1]] for r in range(j - i)]
        size = np.array([len(s) for s in sets])
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            for x, y in verified(size[s:e], sets[s:e], side[s:e] if cross[s] else None):
                a.append(rep[s + x])
                b.append(rep[s + y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def representatives(shape: DataFrame) -> DataFrame:
    """doc_id, n, rep: the least doc_id with an equal set (k1, k2, n), null for empty sets and null ids.

    A set that a third of all rows have is spread over SALTS, both where it is counted and where
    the representative is joined back.
    """
    salted = shape.select("doc_id", "n", "k1", "k2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    part = salted.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n", "salt").agg(F.min("doc_id").alias("least"))
    whole = part.groupBy("k1", "k2", "n").agg(F.min("least").alias("rep"))
    named = part.drop("least").join(whole, ["k1", "k2", "n"])
    return salted.join(named, ["k1", "k2", "n", "salt"], "left").select("doc_id", "n", "rep")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; doc_id is a whole number."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = saved(shapes(docs, frequent_shingles(docs)))
    rep_of = saved(representatives(shape))

    # indexed shingles that two texts hold, and which
    index = shape.filter("doc_id is not null").select("doc_id", F.explode("index").alias("shingle"))
    common = index.groupBy("shingle").agg(F.count("*").alias("members")).filter("members > 1").select("shingle")
    held = saved(index.join(common, "shingle"))
    # of shingles that the same texts hold, one is enough
    name = [F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")]
    one = saved(held.groupBy("shingle").agg(F.count("*").alias("members"), *name)
                .groupBy("x", "y", "members").agg(F.min("shingle").alias("shingle")).select("shingle", "members"))
    member = (held.join(one, "shingle").join(rep_of.filter("rep is not null").distinct(), "doc_id")
              .groupBy("shingle", "rep", "n").agg(F.max("members").alias("members")))
    points = (shape.filter("n > 0").select("doc_id", "point").join(rep_of.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
              .dropDuplicates(["doc_id"]))
    points = points.withColumnRenamed("doc_id", "rep")
    family = families(clusters(member, "shingle", TREE, _largest(one), lambda some: some.join(points, "rep"), _forests, ["n", "rep"]))
    linked = clusters(family, "family", FAMILY, _largest(family), lambda some: with_texts(docs, some), _links, ["rep"]).select(F.col("id").alias("rep"), "component")
    return (rep_of.join(linked, "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")))


def _largest(groups: DataFrame) -> int:
    return groups.agg(F.max("members")).head()[0] or 0


def families(parts: DataFrame) -> DataFrame:
    """rep, family, members: components (id, component) with their sizes; saved."""
    family = parts.select(F.col("id").alias("rep"), F.col("component").alias("family"))
    return saved(family.join(family.groupBy("family").agg(F.count("*").alias("members")), "family"))


def with_texts(docs: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` (with doc_ids in rep) with their texts; only texts that are needed are shuffled."""
    texts = narrowed(docs, some.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text"))
    return texts.join(some.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"]).join(some, "rep")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


#: The same in DuckDB, by an inverted index of all shingles; for small tables.
SQL = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
  lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + {WIDTH - 1}], ' ') as sh from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - {WIDTH - 1}, least(len(w), 1)))) as k from w)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= {PERCENT} * (x.n + y.n - common)),
r as (select distinct doc_id as id, doc_id as c from documents where doc_id is not null
  union select r.id, t.b from r join (select a, b from e union all select b, a from e) t on t.a = r.c)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select id, min(c) as c from r group by 1) m on m.id = d.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near copies.

    Rows without a doc_id have no group and stay; repeated rows of the one that stays all stay;
    null and empty texts stay; an empty table stays empty; all columns are kept as they are.
    """
    groups = jaccard_join(docs)
    keep = groups.filter("component_id = doc_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
