"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Text is folded first: lower case, compatibility forms and accents fall away, look-alike
letters of other scripts and digits written for letters become letters, everything else a
space.  One automaton finds all terms: whole words
(" term ") and word beginnings (" term").  A match inside an exception phrase does not count.
The weights of the matches, normalised by the text's length, give the score.

Terms, weights and exceptions are learnt from a bounded sample of labelled rows (TOXIC and
CLEAN): a term is what occurs in the texts of label 1 and hardly in others.  Counts are added
up in the executors; only terms that pass the thresholds reach the driver.  Every row is
scored, whole, where it lies: scoring shuffles nothing.

Defined results: a null or empty text matches nothing and gets the score of no match;
a text of any length is scored whole; without rows of both labels every score is the smoothed
share of label 1; repeated rows get equal scores; a null doc_id is scored, is not held out and is
never learnt from; there are no ties, as every row is scored alone; an empty table gives an empty
result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType

from .shared import held_out, rows_where, saved, table

#: Labelled rows that are learnt from, at most, of each label; those with the least hash of doc_id.
TOXIC, CLEAN = 3000, 6000
#: A term occurs in this share of the toxic texts at least (and 5), and among all texts that hold
#: it toxic ones have this share.
SHARE, PURITY = 0.004, 0.5
#: Texts of either label that every term's counts begin with, so rare terms weigh less.
PRIOR = 2
#: Letters of a word beginning that can be a term.
PREFIX = (4, 5, 6, 7)
#: A phrase is an exception if so many texts hold it, none of them toxic, and this share of the
#: texts of label 0 that hold its term.
PHRASE, PHRASE_SHARE = 5, 0.2
#: A text is toxic from this score on.
LIMIT = 0.5

# Digits and letters of other scripts that stand for Latin letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")


class _Fold(dict):
    """What str.translate puts for each character; filled as characters occur."""

    def __missing__(self, code: int):
        if code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible
            self[code] = ""
            return ""
        # compatibility forms (full width, mathematical letters, ligatures) and accents fall away
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        plain = "".join(c for c in plain if not 0x300 <= ord(c) < 0x370)
        got = "".join(c if c.isalpha() else " " for c in (DIGITS.get(c, LOOKALIKES.get(c, c)) for c in plain))
        self[code] = got if plain or 0x300 <= code < 0x370 else " "
        return self[code]


_fold = _Fold()


def fold(text: str) -> str:
    """Letters and single or more spaces; begins and ends with a space."""
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _INSIDE.sub(lambda m: SIGNS[m.group()], text)
    return f" {text.translate(_fold)} "


@dataclass
class Lexicon:
    """Weights by pattern, exception phrases, and the score's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                a.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, folded: str) -> tuple[float, float]:
        """The weight of the matches, and that by the square root of the length in words."""
        if not self.weights:
            return 0.0, 0.0
        hits, holes = [], []
        for end, (size, weight) in self.automaton().iter(folded):
            (holes if weight is None else hits).append((end - size + 1, end, weight))
        if not hits:
            return 0.0, 0.0
        if holes:  # a match is inside a hole if one that begins no later ends no earlier
            holes.sort()
            starts, ends = [h[0] for h in holes], list(accumulate((h[1] for h in holes), max))
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]
        total = sum(w for _, _, w in hits)
        return np.log1p(total), total / max(1, folded.count(" ") - 1) ** 0.5

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        x, y = self.features(fold(text))
        a, b, c = self.coef
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))

    def scores(self, texts: pa.Array) -> list[float]:
        return [self.score(texts[k].as_py() or "") for k in range(len(texts))]


def _terms(text: str) -> set[str]:
    own = set()
    for w in set(fold(text).split()):
        if len(w) >= 3:
            own.add(f" {w} ")
        own.update(f" {w[:k]}" for k in PREFIX if len(w) > k)
    return own


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Texts and labels of at most ``toxic`` + ``clean`` rows; of near copies mostly one."""
    least = F.array_min(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    rows = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    some = [rows.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # bounded by the limits
    return docs.select("doc_id", F.col("text").cast("string")).filter("text is not null").join(chosen, "doc_id").select(
        "text", "toxic", F.split(F.lower("text"), r"\s+").alias("w")).select("text", "toxic", least.alias("m")).groupBy("m", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Lexicon:
    """The lexicon of the labelled rows that are not held out; labels: doc_id, toxic."""
    sample = saved(_sample(docs, labels, toxic, clean))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon({}, constant=(n.get(1, 0) + 0.5) / (n.get(1, 0) + n.get(0, 0) + 1))

    def count(batches):
        for batch in batches:
            got = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got[label].update(_terms(text))
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(got[k]), pa.string()), pa.array([k] * len(got[k]), pa.int32()), pa.array(list(got[k].values()), pa.int64())],
                    ["term", "toxic", "n"])

    counts = sample.mapInArrow(count, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    weight = F.log((F.col("p") + PRIOR) / (n[1] + 2 * PRIOR)) - F.log((F.col("q") + PRIOR) / (n[0] + 2 * PRIOR))
    best = (counts.filter((F.col("p") >= max(5, SHARE * n[1])) & (F.col("p") >= PURITY * (F.col("p") + F.col("q"))))
            .select("term", "p", "q", weight.alias("w")).filter("w > 1").orderBy("term").collect())  # each is in a share of the sample: few
    q = {r["term"]: r["q"] for r in best}
    p, w = {r["term"]: r["p"] for r in best}, {r["term"]: r["w"] for r in best}
    kept = {}
    for t in sorted(p, key=lambda t: (len(t.strip()), t.endswith(" "), t)):
        longer = [x for x in p if x != t and x.startswith(t)] if not t.endswith(" ") else []
        if not any(p[x] >= 0.8 * p[t] and w[x] >= w[t] for x in longer):  # else it adds nothing to the longer one
            kept[t] = w[t]
    lexicon = Lexicon(kept)

    def contexts(batches):
        for batch in batches:
            got = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, phrases = fold(text).split(), set()
                for i, x in enumerate(words):
                    for t in [t for t in (f" {x} ", *(f" {x[:k]}" for k in PREFIX)) if t in kept]:
                        phrases.update((t, " ".join(words[a:b])) for a, b in ((i - 1, i + 1), (i, i + 2)) if a >= 0 and b <= len(words))
                got[label].update(phrases)
            for k in (0, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in got[k]], pa.string()), pa.array([x for _, x in got[k]], pa.string()),
                     pa.array([k] * len(got[k]), pa.int32()), pa.array(list(got[k].values()), pa.int64())],
                    ["term", "phrase", "toxic", "n"])

    phrases = (sample.mapInArrow(contexts, "term string, phrase string, toxic int, n long").groupBy("term", "phrase")
               .agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum("n").alias("n"))
               .filter((F.col("clean") >= PHRASE) & (F.col("clean") == F.col("n"))).collect())
    lexicon.exceptions = tuple(sorted({r["phrase"] for r in phrases if r["clean"] >= PHRASE_SHARE * q[r["term"]]}))

    def draw(batches):
        for batch in batches:
            f = [lexicon.features(fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64()), batch.column(1)], ["x", "y", "toxic"])

    # the bounded sample's features; sorted, so that the sums don't depend on the order of tasks
    got = sample.mapInArrow(draw, "x double, y double, toxic int").toArrow().sort_by([("x", "ascending"), ("y", "ascending"), ("toxic", "ascending")])
    x = np.stack([np.ones(got.num_rows), got.column("x").to_numpy(), got.column("y").to_numpy()], axis=1)
    lexicon.coef = tuple(_logistic(x, got.column("toxic").to_numpy().astype(float)))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Coefficients by Newton's method."""
    c = np.zeros(x.shape[1])
    for _ in range(30):
        z = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x.T * (z * (1 - z))) @ x + ridge * np.eye(len(c)), x.T @ (z - y) + ridge * c)
        c -= np.clip(step, -5, 5)
    return c


def toxicity(docs: DataFrame, lexicon: Lexicon, into: str = "score") -> DataFrame:
    """All columns of ``docs`` but text, and the score (0 to 1) of its text, which replaces a column of that name."""
    names = [c for c in docs.columns if c not in (into, "text")]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lexicon.scores(batch.column(0)), pa.float64())], [*names, into])

    schema = StructType([docs.schema[c] for c in names]).add(into, DoubleType())
    return docs.select(F.col("text").cast("string").alias("text"), *names).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, with all their columns.

    A null or empty text matches nothing and stays; each repeated row is judged alike; an empty
    table stays empty; columns of any other name are kept as they are.
    """
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return rows_where(docs, lambda texts: np.array(lexicon.scores(texts)) < LIMIT)
