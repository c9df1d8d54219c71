"""A factorisation machine that scores the quality of texts.

Inputs are hashed words (counts, normalised), structure statistics and the length of the
text.  Every two inputs interact through the product of their low-rank factors; the sum over
all pairs takes linear time by the identity 2 * sum_{i<j} <v_i, v_j> x_i x_j =
sum_f ((sum_i v_if x_i)**2 - sum_i (v_if x_i)**2).

The machine is fitted on a bounded sample of labelled rows (SAMPLE), gathered as features,
not as texts; every row is scored, whole, where it lies: scoring shuffles nothing.

Defined results: a null or empty text has no words and gets the score of its statistics; a
text of any length is scored whole; without labelled rows, or with one label only, every score
is the smoothed share of label 1; repeated rows get equal scores, and a label whose document is
repeated counts once; a null doc_id is scored, is not held out and is never learnt from; there
are no ties, as every row is scored alone; an empty table gives an empty result; labels without
a value or document are not used; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType

from .hashing import Words, chunks, distinct, shingles
from .shared import held_out, rows_where, table

#: Distinct labelled documents that the machine is fitted on, at most; those with the least hash of doc_id.
SAMPLE = 6000
#: Inputs that words are hashed to, and the rank of the interactions.
BUCKETS, RANK = 1 << 13, 6
EPOCHS, STEP, DECAY, SEED = 12, 0.1, 1e-5, 7
#: A document is good from this score on.
GOOD = 0.3
N_STATS = 14
_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "marks": b"!?",
    "bars": b"|", "stops": b".,;:", "lines": b"\n"}.items()}


def statistics(w: Words) -> np.ndarray:
    """N_STATS structure statistics of each text, about 0 to 1 each."""
    n = np.maximum(w.counts, 1).astype(float)
    size = np.maximum(np.diff(w.texts), 1).astype(float)
    held = {}
    for name, member in _CLASS.items():
        sums = np.concatenate([[0], np.cumsum(member[w.data])])
        held[name] = np.diff(sums[w.texts]).astype(float)
    length = np.concatenate([[0], np.cumsum(w.end - w.start)])
    owner, keys = shingles(w)
    total = np.bincount(owner, minlength=len(n))
    unique = np.bincount(distinct(owner, keys)[0], minlength=len(n))
    text = np.repeat(np.arange(len(n)), w.counts)
    different = np.bincount(distinct(text, w.hash)[0], minlength=len(n))
    same = np.zeros(len(n))
    if len(text) > 1:
        again = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
        same = np.bincount(text[1:][again], minlength=len(n))
    repeated = 1 - unique / np.maximum(total, 1)
    return np.stack([
        np.log1p(w.counts) / 8, np.diff(length[w.first]) / n / 10,
        np.minimum(held["symbols"] / n, 4), np.minimum(held["marks"] / n, 3), held["upper"] / size, held["digits"] / size,
        np.minimum(held["bars"] / n, 1), held["stops"] / n, np.minimum(held["lines"] / n, 1) * 5,
        different / n * (w.counts > 0), same / n, repeated * (total > 0), (repeated > 0.2).astype(float), np.log1p(size) / 12,
    ], axis=1).astype(np.float32)


def inputs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, input, value) of each hashed word of each text."""
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    pair = text * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    found, n = np.unique(pair, return_counts=True)
    text, n = found // BUCKETS, n.astype(np.float32)
    norm = np.sqrt(np.bincount(text, n * n, minlength=len(w.counts)))
    return text, found % BUCKETS, (n / np.maximum(norm[text], 1e-9)).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # of the inputs; the statistics come after the words
    factor: np.ndarray
    mean: np.ndarray  # of the statistics
    scale: np.ndarray
    constant: float | None = None

    def sums(self, text, index, value, n):
        """The linear part, the factor sums and the sums of their squares of each text."""
        part = self.factor[index] * value[:, None]
        at = np.searchsorted(text, np.arange(n))
        has = np.bincount(text, minlength=n) > 0
        s, q = np.zeros((n, self.factor.shape[1]), np.float32), np.zeros((n, self.factor.shape[1]), np.float32)
        linear = np.bincount(text, self.weight[index] * value, minlength=n)
        if len(text):
            s[has] = np.add.reduceat(part, at[has], axis=0)
            q[has] = np.add.reduceat(part * part, at[has], axis=0)
        return linear, s, q

    def raw(self, words, stats):
        """Scores before the logistic function; linear in the number of inputs."""
        text, index, value, n = *words, len(stats)
        x = (stats - self.mean) / self.scale
        linear, s, q = self.sums(text, index, value, n)
        w, v = self.weight[BUCKETS:], self.factor[BUCKETS:]
        s, q = s + x @ v, q + (x * x) @ (v * v)
        return self.bias + linear + x @ w + 0.5 * (s * s - q).sum(axis=1), s, x

    def score(self, words, stats):
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(words, stats)[0], -30, 30)))


def fit(rows: list[tuple], labels: np.ndarray) -> Machine:
    """rows: (inputs, values, statistics) of each labelled text."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    rng = np.random.default_rng(SEED)
    stats = np.array([r[2] for r in rows], np.float32).reshape(n, N_STATS)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS + N_STATS, np.float32),
                rng.normal(0, 0.02, (BUCKETS + N_STATS, RANK)).astype(np.float32),
                stats.mean(axis=0) if n else np.zeros(N_STATS, np.float32), (stats.std(axis=0) if n else np.zeros(N_STATS, np.float32)) + 1e-2)
    if n == 0 or labels.min() == labels.max():
        m.constant = float(share)
        return m
    gw, gv, gb = np.full_like(m.weight, 1e-3), np.full_like(m.factor, 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 64):
            pick = order[i : i + 64]
            text = np.repeat(np.arange(len(pick)), [len(rows[p][0]) for p in pick])
            index = np.concatenate([rows[p][0] for p in pick]).astype(np.int64)
            value = np.concatenate([rows[p][1] for p in pick]).astype(np.float32)
            z, s, x = m.raw((text, index, value), stats[pick])
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
            dw = np.bincount(index, d[text] * value, minlength=BUCKETS + N_STATS).astype(np.float32)
            part = (d[text] * value)[:, None] * (s[text] - m.factor[index] * value[:, None])
            dv = np.stack([np.bincount(index, part[:, f], minlength=BUCKETS + N_STATS) for f in range(RANK)], axis=1).astype(np.float32)
            dw[BUCKETS:] += d @ x
            dv[BUCKETS:] += x.T @ (d[:, None] * s) - (d @ (x * x))[:, None] * m.factor[BUCKETS:]
            dw += DECAY * m.weight
            dv += DECAY * m.factor
            db = float(d.sum())
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            m.weight -= STEP * dw / np.sqrt(gw)
            m.factor -= STEP * dv / np.sqrt(gv)
            m.bias -= STEP * db / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on the labelled rows that are not held out; labels: doc_id, quality."""
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            for i, j, w in chunks(batch.column(1)):
                text, index, value = inputs(w)
                at = np.searchsorted(text, np.arange(j - i + 1))
                stats = statistics(w)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(index, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value, pa.float32())),
                    pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * N_STATS, pa.int32()), pa.array(stats.ravel(), pa.float32())),
                ], ["doc_id", "quality", "i", "v", "s"])

    key = docs.schema["doc_id"].dataType.simpleString()
    drawn = (found.select("doc_id", F.col("text").cast("string"), "quality")
             .mapInArrow(run, f"doc_id {key}, quality int, i array<int>, v array<float>, s array<float>"))
    # one row for each label, however often its document is repeated
    got = drawn.groupBy("doc_id", "quality").agg(F.min(F.struct("i", "v", "s")).alias("x")).select("doc_id", "quality", "x.i", "x.v", "x.s").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    cols = [got.column(k).combine_chunks() for k in "ivs"]
    rows = [tuple(c[k].values.to_numpy(zero_copy_only=False) for c in cols) for k in range(got.num_rows)]
    return fit(rows, got.column("quality").to_numpy().astype(np.float32))


def scores_of(machine: Machine, texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, j, w in chunks(texts):
        out[i:j] = machine.score(inputs(w), statistics(w))
    return out


def classify(docs: DataFrame, machine: Machine, into: str = "score") -> DataFrame:
    """All columns of ``docs`` but text, and the score (0 to 1) of its text, which replaces a column of that name."""
    names = [c for c in docs.columns if c not in (into, "text")]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores_of(machine, batch.column(0)))], [*names, into])

    schema = StructType([docs.schema[c] for c in names]).add(into, DoubleType())
    return docs.select(F.col("text").cast("string").alias("text"), *names).mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, with all their columns.

    A null or empty text is judged like any other; each repeated row is judged alike; an empty
    table stays empty; columns of any other name are kept as they are.
    """
    machine = train(docs, table(spark, sf_dir, "labels"))
    return rows_where(docs, lambda texts: scores_of(machine, texts) >= GOOD)
