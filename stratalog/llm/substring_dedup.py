"""Removal of passages that repeat across documents, by MinHash banding of paragraphs.

Passages stand at any place of a line, so a text has two kinds of paragraphs: its lines of LINE
words or more, and overlapping pieces of PIECE words inside them, which begin at places chosen
by content, so that equal passages have equal pieces wherever they stand.

1. Where to look.  Two paragraphs of Jaccard similarity 0.8 over 5-word shingles share a run of
   23 words (a changed word breaks five shingles, so few words can differ).  Every run of
   WINDOW + REACH - 1 words holds a window of WINDOW words that begins at the least shingle hash
   of REACH in a row.  Only paragraphs with a window that another document has too go on; nothing
   is decided by that.
2. MinHash bands.  Each distinct line gets the keys of BANDS bands of ROWS minima of its shingles'
   hashes: 98.7 % of the pairs at 0.8 collide, 99.9 % at 0.9.  A piece has 12 shingles, of which a
   changed word breaks five; similar pieces are equal ones, which every band would bring together
   (so one key does, the hash of all words), or pieces that begin a word later, which must not
   link: over them a passage would creep along its document.
3. Verification.  Lines that collide, directly or over others, are a family; in families all pairs
   are compared by the exact Jaccard similarity of their shingles, in blocks where they are large.
   Paragraphs of the same words are one to begin with.
4. Components of the verified pairs: of each the paragraphs of the least document stay, the others
   are removals.  A document's removals are united to spans; spans of LEAST words or more go.

Any passage of LEAST + 2 * (REACH - 1) words that two documents share is found.  What is shuffled is a few dozen bytes for each window and paragraph, and the texts of
documents with a repeated window; a hot passage is pre-aggregated to one row per task before its
least document is sought, and joins back can be split.

Defined results: null or empty texts and null doc_ids have no paragraphs; texts of any length are
taken whole; repeats inside one document are not removed; repeated rows of one doc_id count as one
document; ties of documents go to the least doc_id; an empty table gives an empty result; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .graph import components
from .hashing import WIDTH, Words, chunks, mix, words
from .jaccard_join import FAMILY, _largest, _links, clusters, families
from .shared import narrowed, saved, table, unused

LINE, BANDS, ROWS = 30, 6, 3
PIECE = 16
WINDOW, REACH = 12, 12
#: Words of the shortest span that is removed.
LEAST = 20


def _within(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each full shingle (in one text), and its hash."""
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    m = max(0, len(w.hash) - WIDTH + 1)
    total = np.zeros(m, np.uint64)
    for k in range(WIDTH):
        total += mix(w.hash[k : k + m], k)
    at = np.flatnonzero(text[:m] == text[len(text) - m :]) if m else np.zeros(0, int)
    return at, mix(total[at])


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first word) of the windows; words count from the text's first."""
    at, h = _within(w)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    m = len(h) - REACH + 1
    if m <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
    best, place = h[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, REACH):
        less = h[k : k + m] <= best
        best[less], place[less] = h[k : k + m][less], k
    whole = at[REACH - 1 :] - at[:m] == REACH - 1  # places follow each other in one text
    pick = np.unique((np.arange(m) + place)[whole])
    first = at[pick]
    ends = w.first[1:][text[first]]
    fits = first + WINDOW <= ends
    pick, first = pick[fits], first[fits]
    key = np.zeros(len(pick), np.uint64)
    for n, k in enumerate((*range(0, WINDOW - WIDTH, WIDTH), WINDOW - WIDTH)):
        key += mix(h[pick + k], 20 + n)
    own = text[first]
    return own, mix(key, 3), first - w.first[own]


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the lines with LINE words or more, words of all texts counted through."""
    breaks = np.concatenate([np.flatnonzero(w.data == 10), w.texts[1:-1]])
    cut = np.unique(np.concatenate([[0], np.searchsorted(w.start, np.sort(breaks)), [len(w.start)]]))
    a, b = cut[:-1], cut[1:]
    long = b - a >= LINE
    a, b = a[long], b[long]
    return np.searchsorted(w.first, a, "right") - 1, a, b


def wholes(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of all words of each line."""
    if not len(a):
        return np.zeros(0, np.uint64)
    run, size = _runs(a, b - a)
    return mix(np.add.reduceat(mix(w.hash[run] + mix((run - np.repeat(a, b - a)).astype(np.uint64))), np.cumsum(size) - size), 8)


def bands(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The band keys of each line [a, b): hashes of ROWS minima each."""
    at, h = _within(w)
    s, e = np.searchsorted(at, a), np.searchsorted(at, b - WIDTH + 1)
    keys = np.zeros((len(a), BANDS), np.uint64)
    if not len(a):
        return keys
    # only shingles of the lines, one after the other
    run, size = _runs(s, e - s)
    own, starts = h[run], np.cumsum(size) - size
    for p in range(BANDS * ROWS):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * p + 1)) % 2**64 | 1)
        keys[:, p // ROWS] += mix(np.minimum.reduceat(own * odd, starts), 40 + p)
    return mix(keys + np.arange(BANDS, dtype=np.uint64), 4)


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of runs, one run after the other, and the runs' sizes."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


def _rows(*columns: np.ndarray, names: list[str]):
    """Record batches of bounded size."""
    for k in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], names)


def places(docs: DataFrame) -> DataFrame:
    """key, id, first: the windows of each document."""
    def run(batches):
        for batch in batches:
            for i, j, w in chunks(batch.column(1)):
                ids = batch.column(0).slice(i, j - i).to_numpy()
                t, key, first = windows(w)
                yield from _rows(key.view(np.int64), ids[t], first.astype(np.int32), names=["key", "id", "first"])

    return docs.mapInArrow(run, "key long, id long, first int")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and the first words of its windows that another document has too."""
    units = places(docs)
    # saved, so that both sides of the join are plain exchanges and Spark can split a hot key's rows
    common = saved(units.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("key"))
    return units.join(common, "key").groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("first").alias("hits"))  # one document's at most


def paragraphs(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """exact, doc_id, place, keys: the paragraphs that hold a repeated window.

    ``exact`` is the hash of all words; a line's band keys come with the first such line that a
    task sees, other paragraphs have none.
    """
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, texts, found = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for i, j, w in chunks(texts):
                some = found.slice(i, j - i)
                at = np.repeat(w.first[:-1], some.value_lengths().to_numpy()) + some.flatten().to_numpy()
                at = np.sort(at)
                text, a, b = lines(w)
                held = np.searchsorted(at, b - WINDOW, "right") > np.searchsorted(at, a)
                a, b = a[held], b[held]
                ends = w.first[np.searchsorted(w.first, at, "right")]
                fits = at + PIECE <= ends
                p, q = at[fits], at[fits] + PIECE
                keys = bands(w, a, b).view(np.int64)
                first, last = np.concatenate([a, p]), np.concatenate([b, q])
                exact = wholes(w, first, last).view(np.int64)
                own = np.searchsorted(w.first, first, "right") - 1
                new = [x not in seen and not seen.add(x) for x in exact[: len(a)].tolist()]
                keys = [k if n else [] for k, n in zip(keys, new)] + [[]] * len(p)
                yield pa.RecordBatch.from_arrays([
                    pa.array(exact), pa.array(ids[i:j][own]), pa.array(_place(first - w.first[own], last - w.first[own])),
                    pa.array(keys, pa.list_(pa.int64()))], ["exact", "doc_id", "place", "keys"])

    near = narrowed(docs, hits).join(hits, "doc_id").select("doc_id", "text", "hits")
    return near.mapInArrow(run, "exact long, doc_id long, place long, keys array<long>")


def _place(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 32) | last.astype(np.int64)


#: The parts of a place, as SQL.
FIRST, LAST = "shiftright(place, 32)", "place & 4294967295"


def _line_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """rep and the text of each needed line (rep, doc_id, place)."""
    by_doc = needed.groupBy("doc_id").agg(F.collect_list(F.struct("rep", F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"))).alias("want"))

    def run(batches):
        for batch in batches:
            want = batch.column(1)
            for i, j, w in chunks(batch.column(0)):
                reps, texts = [], []
                for r in range(i, j):
                    for x in want[r].as_py():
                        reps.append(x["rep"])
                        texts.append(w.data[w.start[w.first[r - i] + x["first"]] : w.end[w.first[r - i] + x["last"] - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(texts, pa.string())], ["rep", "text"])

    return narrowed(docs, needed).join(by_doc, "doc_id").select("text", "want").mapInArrow(run, "rep long, text string")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, first, last (words, end exclusive), n_words, kept_doc: the spans to remove.

    ``kept_doc`` is a document in which the passage stays.
    """
    docs = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .filter("doc_id is not null and text is not null"))
    found = saved(paragraphs(docs, saved(repeated(docs))))

    # different lines: those that collide in a band, directly or over others, are a family, and all its pairs are verified
    units = found.select(F.explode("keys").alias("key"), "exact")
    heads = saved(units.groupBy("key").agg(F.min("exact").alias("head"), F.max("exact").alias("other")).filter("head <> other").select("key", "head"))
    collide = units.join(heads, "key").filter("exact <> head").select(F.col("exact").alias("a"), F.col("head").alias("b"))
    family = families(components(collide))
    # paragraphs of the same words are one; where it stands first is where its words are read
    one = found.groupBy("exact").agg(F.min(F.struct("doc_id", "place")).alias("p"), F.max("doc_id").alias("last_doc"))
    one = saved(one.select(F.col("exact").alias("rep"), "p.doc_id", "p.place", "last_doc"))
    joined = clusters(family, "family", FAMILY, _largest(family), lambda some: _line_texts(docs, one.join(some.select("rep").distinct(), "rep", "left_semi").drop("last_doc"))
                      .dropDuplicates(["rep"]).join(some, "rep"), _links, ["rep"]).select(F.col("id").alias("rep"), "component")
    # of a component the least document keeps its paragraphs
    part = saved(one.join(joined, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"), "doc_id", "last_doc"))
    kept = part.groupBy("component").agg(F.min("doc_id").alias("kept_doc"), F.max("last_doc").alias("last")).filter("kept_doc <> last").select("component", "kept_doc")
    keeper = saved(part.join(kept, "component").select(F.col("rep").alias("exact"), "kept_doc"))
    gone = found.select("exact", "doc_id", "place").join(keeper, "exact").filter("doc_id <> kept_doc").select("doc_id", "place", "kept_doc")
    gone = gone.select("doc_id", F.expr(FIRST).alias("first"), F.expr(LAST).alias("last"), "kept_doc")

    order = Window.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (gone.groupBy("doc_id", "first", "last").agg(F.min("kept_doc").alias("kept_doc"))
             .withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
             .withColumn("span", F.sum("new").over(order))
             .groupBy("doc_id", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("kept_doc").alias("kept_doc")))
    return spans.withColumn("n_words", (F.col("last") - F.col("first"))).filter(F.col("n_words") >= LEAST).select(
        "doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("n_words").cast("long").alias("n_words"), "kept_doc")


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of the spans, and the space after them, taken out of ``text``."""
    names, own = docs.columns, unused(docs, "spans")
    by_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(own))
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(at), batch.column(len(names))
            out = []
            for r in range(batch.num_rows):
                text = texts[r].as_py()
                if text is not None and cuts[r].is_valid:
                    raw = text.encode()
                    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    parts, last = [], 0
                    for s in cuts[r].as_py():
                        b = int(w.start[s["last"]]) if s["last"] < len(w.start) else len(raw)
                        parts.append(raw[last : int(w.start[s["first"]])])
                        last = b
                    text = b"".join([*parts, raw[last:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    return docs.join(by_doc, "doc_id", "left").select(*names, own).mapInArrow(run, docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier document holds; n_chars follows the text."""
    out = cut(docs, repeats(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
