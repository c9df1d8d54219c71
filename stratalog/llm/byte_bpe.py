"""Byte-level BPE as a monoid: encodings of two halves are joined at their seam.

Text is split by the vocabulary's pattern; a piece is encoded by halves down to short
leaves.  Neighbouring encodings are joined by encoding a window of tokens around the seam
again.  The window grows until the tokens outside provably stay as they are: a sequence
of tokens is the encoding of its bytes if and only if each two neighbours are the
encoding of *their* bytes, and all neighbours but those at the window's edges are so
already.  Decoding concatenates the halves' bytes up the same tree; the pieces of a text
are independent, so a text is the concatenation of its pieces both ways.

Work is row-local: no shuffle, and memory holds one batch and a bounded piece cache.

Defined results: a null text counts as empty (no ids); texts of any length are encoded
whole; repeated rows and null doc_ids give a result each; of merges of one rank the leftmost
goes first; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import table

#: Bytes of the longest piece that is merged directly.
LEAF = 6
#: Distinct pieces that a task keeps, about, in each of two generations (one text may add to that); also the leaves and the seams.
CACHE = 200_000
#: Bytes of text in a batch that goes back to Spark.
BATCH = 2_000_000
#: Characters whose classes differ between the two regular expression modules, and all beyond Latin.
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
#: The pattern in the faster module; equal on texts without ODD characters.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Codec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.exact = regex.compile(pattern)
        self.plain = PLAIN if pattern == _public_pattern() else self.exact
        self.leaves: dict[bytes, list[int]] = {}
        self.seams: dict[int, list[int]] = {}
        self.new: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            lines = (x.split() for x in f if x.strip())
            return cls({base64.b64decode(a): int(b) for a, b in lines}, pattern)

    def leaf(self, piece: bytes) -> list[int]:
        """The merges of one piece, lowest rank first, leftmost of equals first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        none = len(ranks) + 1 << 32
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank and (low := min(rank)) != none:
            i = rank.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def seam(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens."""
        if (known := self.seams.get(a << 32 | b)) is None:
            if len(self.seams) >= CACHE:
                self.seams.clear()
            known = self.seams[a << 32 | b] = self.leaf(self.tokens[a] + self.tokens[b])
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        return len(x := self.seam(a, b)) == 2 and x[0] == a

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left or right
        a = b = 1
        middle = self.seam(left[-1], right[0])
        while True:
            ok_left = a == len(left) or self.stable(left[-a - 1], middle[0])
            ok_right = b == len(right) or self.stable(middle[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + middle + right[b:]
            a = a if ok_left else min(len(left), 2 * a)
            b = b if ok_right else min(len(right), 2 * b)
            middle = self.leaf(self.decode(left[len(left) - a :] + right[:b]))

    def piece(self, data: bytes) -> list[int]:
        """The encoding of one match of the pattern."""
        if len(data) <= LEAF:
            if (known := self.leaves.get(data)) is None:
                if len(self.leaves) >= CACHE:
                    self.leaves.clear()
                known = self.leaves[data] = self.leaf(data)
            return known
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 64:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def both(self, piece: str) -> tuple[bytes, bytes]:
        """A piece's ids as 32-bit words, and the bytes decoded from them."""
        if (known := self.old.get(piece)) is None:
            ids = self.piece(piece.encode())
            known = array("i", ids).tobytes(), self.decode(ids)
        if len(piece) <= 64:
            self.new[piece] = known
        return known

    def text(self, text: str) -> tuple[bytes, bytes]:
        """The same for a text."""
        if len(self.new) >= CACHE:  # between texts, so that a text is looked up in one generation
            self.new, self.old = {}, self.new
        get, both = self.new.get, self.both
        found = [get(p) or both(p) for p in (self.exact if ODD.search(text) else self.plain).findall(text)]
        if not found:
            return b"", b""
        ids, data = zip(*found)
        return b"".join(ids), b"".join(data)

    def encode(self, text: str) -> list[int]:
        return list(array("i", self.text(text)[0]))


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_loaded: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary file, loaded once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec.load(path, pattern)
    return _loaded[path, pattern]


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes decoded from them, for every row of ``docs``.

    ``path`` is the vocabulary's file, which every machine has.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary"

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            begin, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                rows.append(c.text(text))
                size += len(text)
                if size >= BATCH or i + 1 == batch.num_rows:
                    ends = [0]
                    for x, _ in rows:
                        ends.append(ends[-1] + len(x) // 4)
                    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join([x for x, _ in rows]))])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(begin, len(rows)), ids, pa.array([y for _, y in rows], pa.binary())],
                        ["doc_id", "ids", "decoded"],
                    )
                    begin, size, rows = i + 1, 0, []

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    out = byte_bpe(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
