"""Byte-level BPE encoding and decoding by tree concatenation.

A text of more than LEAF bytes is halved, wherever its middle falls, until no part is longer; the parts are dealt out and encoded
in parallel.  Then the halves' ids are joined, two and two, up the tree.  Around each join a window of text is encoded again
and grows until its ids agree with those that stand on either side of it; what lies in the agreed span is exchanged.  The
texts of the windows come from the ids themselves, so no text travels with them.

Why agreement is enough.  The tokenizer scans a text from the left by a pattern that never looks back, and merges pairs within
what the pattern matched.

- Where a white-space character follows another kind of character, every scan stops, whatever stands around.  A window that
  begins and ends at such places, or at a text's own ends, has the ids of the whole.
- Without such a place (a long run of letters, a text in a script without spaces) one whole token must be the same.  A list of
  tokens of one match is what merging makes exactly if it makes each two neighbours from the two joined, so tokens up to the
  shared one from one side and after it from the other are right.  The scan is the same beyond the shared token where it lies
  in a run of one class of characters: it must have no apostrophe in it or just before it, for contractions are no runs, and
  keep MARGIN bytes from the cut and the window's end, for the pattern looks two characters ahead.

Special tokens are cut out of a text first, as the library does, and texts between them are separate.

Defined results: a null or empty text has no ids, and the hashes of nothing; rows that repeat a doc_id are encoded one by one; a
null doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import STEP_BYTES, Encoder, encoder
from ._frames import in_batches, stored
from ._text import ranges, release, steps

#: Bytes of a part at most; bytes that a window has on either side of a join at first; bytes that two characters take at most.
LEAF, WINDOW, MARGIN = 16384, 64, 8

#: Certain places where a scan stops: before white space that follows another character.
_STOP = re.compile(rb"(?<=[!-~])(?=[ \t\n\v\f\r])")


def halves(raw: bytes, leaf: int) -> list[bytes]:
    """The leaves of a text's tree, in order; cuts fall between characters."""
    if len(raw) <= leaf:
        return [raw] if raw else []
    at = len(raw) // 2
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    # a text of one long character is not cut
    return [raw] if at in (0, len(raw)) else halves(raw[:at], leaf) + halves(raw[at:], leaf)


class Tree:
    """Joins encodings of neighbouring texts with one vocabulary."""

    def __init__(self, made: Encoder):
        self.made, self.sizes, self.names = made, made.sizes, made.names
        marks = sorted(made.added, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.windows = 0

    def leaves(self, text: str, leaf: int) -> list[tuple[bool, bytes]]:
        """(whether it goes on the text before it, bytes) of the parts of a text; a special token is a part of its own."""
        parts, at = [], 0
        sections = []
        for m in self.marks.finditer(text) if self.marks else ():
            sections += [text[at : m.start()], m.group()]
            at = m.end()
        for section in [*sections, text[at:]]:
            parts += [(k > 0, raw) for k, raw in enumerate(halves(section.encode(), leaf))]
        return parts

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join([self.names[i] for i in ids.tolist()])

    def encoded(self, raw: bytes) -> np.ndarray:
        return np.array(self.made.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype=np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two texts one after the other, from the ids of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        width = WINDOW
        while True:
            got = self._joined(left, right, width)
            if got is not None:
                return got
            width *= 2

    def _tail(self, ids: np.ndarray, width: int) -> tuple[int, bytes]:
        """How many ids stand before those whose bytes make up the last width bytes or some more, and these bytes."""
        k, size = len(ids), 0
        while k and (size < width or self.names[ids[k]][0] & 0xC0 == 0x80):
            k -= 1
            size += int(self.sizes[ids[k]])
        return k, self.text(ids[k:])

    def _head(self, ids: np.ndarray, width: int) -> tuple[int, bytes]:
        k, size = 0, 0
        while k < len(ids) and (size < width or self.names[ids[k]][0] & 0xC0 == 0x80):
            size += int(self.sizes[ids[k]])
            k += 1
        return k, self.text(ids[:k])

    def _joined(self, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray | None:
        i, before = self._tail(left, width)
        j, after = self._head(right, width)
        raw, cut = before + after, len(before)
        # Byte places where tokens of either side end, within the window.
        left_at = np.concatenate([[0], np.cumsum(self.sizes[left[i:]])])
        right_at = cut + np.concatenate([[0], np.cumsum(self.sizes[right[:j]])])
        begin, anchored = 0, i == 0
        if not anchored:
            stops = [m.start() for m in _STOP.finditer(raw, 0, cut + 1) if MARGIN <= m.start() <= cut - MARGIN]
            if stops:
                begin, anchored = stops[-1], True
            elif b"'" in before[:4]:
                return None
        end, whole = len(raw), j == len(right)
        stops = [m.start() for m in _STOP.finditer(raw) if m.start() > cut and m.start() < len(raw)]
        closed = whole
        if stops:
            end, closed = stops[0], True
        self.windows += 1
        ids = self.encoded(raw[begin:end])
        at = begin + np.concatenate([[0], np.cumsum(self.sizes[ids])])
        head, low = i + int(np.searchsorted(left_at, begin)), 0
        if not anchored:
            shared = self._shared(raw, left[i:], left_at, ids, at, 0, cut - MARGIN)
            if shared is None:
                return None
            head, low = i + shared[0], shared[1]
        tail, high = (len(right), len(ids)) if end == len(raw) and whole else (int(np.searchsorted(right_at, end)), len(ids))
        if not closed:
            shared = self._shared(raw, right[:j], right_at, ids, at, cut, end - MARGIN)
            if shared is None:
                return None
            tail, high = shared
        if high < low:
            return None
        return np.concatenate([left[:head], ids[low:high], right[tail:]])

    @staticmethod
    def _shared(raw: bytes, side: np.ndarray, side_at: np.ndarray, ids: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
        """Of a token that a side and the window share within [low, high]: its index in either."""
        where = {int(p): k for k, p in enumerate(side_at[:-1])}
        for k in range(len(ids)):
            a, b = int(at[k]), int(at[k + 1])
            if low <= a and b <= high and (m := where.get(a)) is not None and side[m] == ids[k] and b"'" not in raw[max(a - 3, 0) : b]:
                return m, k
        return None

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """The ids of consecutive parts of one text, joined as a tree."""
        if len(parts) == 1:
            return parts[0]
        mid = len(parts) // 2
        return self.join(self.joined(parts[:mid]), self.joined(parts[mid:]))

    def whole(self, parts: list[tuple[bool, np.ndarray]]) -> np.ndarray:
        """The ids of a text from those of its leaves."""
        out: list[np.ndarray] = []
        run: list[np.ndarray] = []
        for goes_on, ids in [*parts, (False, None)]:
            if not goes_on and run:
                out.append(self.joined(run))
                run = []
            if ids is not None:
                run.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self.whole([(on, self.encoded(raw)) for on, raw in self.leaves(text, leaf)])


_trees: dict[str, Tree] = {}


def tree(path: str) -> Tree:
    if path not in _trees:
        _trees[path] = Tree(encoder(path))
    return _trees[path]


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
PARTS = "row bigint, doc_id bigint, k int, goes_on boolean, text string"


class Decoder:
    """Ids to bytes by one table."""

    def __init__(self, made: Encoder):
        self.sizes = made.sizes.astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(made.names), np.uint8)

    def texts(self, ids: np.ndarray, at: np.ndarray) -> Iterator[str]:
        """The texts of ids; at says where each text's begin.  Bytes that are no character become U+FFFD."""
        size = self.sizes[ids]
        raw = self.pool[ranges(self.start[ids], size)].tobytes()
        place = np.concatenate([[0], np.cumsum(size)])[at].tolist()
        for a, b in zip(place, place[1:]):
            yield raw[a:b].decode("utf-8", "replace")


def _digests(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray, decoder: Decoder, with_ids: bool) -> pa.RecordBatch:
    wide = ids.astype("<u4")
    raw = memoryview(wide).cast("B")
    of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())]
    of_texts = [hashlib.sha256(t.encode()).hexdigest() for t in decoder.texts(ids, at)]
    columns, names = [doc_ids, pa.array(np.diff(at)), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], [c.split()[0] for c in RESULT.split(", ")]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(wide.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, path: str, with_ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """One row for each row of docs: how many ids it has, the hash of the ids, and that of the text decoded from them; the ids too
    if asked for.  Texts of up to leaf bytes are encoded where they are; the leaves of longer ones are dealt out."""
    schema = RESULT + (", ids array<int>" if with_ids else "")
    rows = in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > leaf

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        decoder = Decoder(made)
        for batch in batches:
            for a, b, _ in steps(batch.column("text"), STEP_BYTES):
                ids, at = made.encode(batch.column("text").slice(a, b - a))
                yield _digests(batch.column("doc_id").slice(a, b - a), ids, at, decoder, with_ids)
        release()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, row = tree(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                parts = made.leaves(text.as_py(), leaf)
                n = len(parts)
                columns = [pa.array([row] * n, pa.int64()), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([p[0] for p in parts], pa.bool_()), pa.array([p[1].decode() for p in parts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "k", "goes_on", "text"])
                row += 1

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            for a, b, _ in steps(batch.column("text"), STEP_BYTES):
                ids, at = made.encode(batch.column("text").slice(a, b - a))
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "k", "goes_on")), blobs], names=["row", "doc_id", "k", "goes_on", "ids"])
        release()

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tree(path)
        decoder = Decoder(made.made)
        row, doc, parts = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if row is not None:
                ids = made.whole(parts)
                yield _digests(pa.array([doc], pa.int64()), ids, np.array([0, len(ids)]), decoder, with_ids)

        for batch in batches:
            for here, doc_id, on, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "goes_on", "ids"))):
                if here != row:
                    yield from done()
                    row, doc, parts = here, doc_id, []
                parts.append((on, np.frombuffer(ids, "<u4").astype(np.int64)))
        yield from done()
        release()

    # The numbers of rows stand once they are stored, whatever task is run again.
    parts = stored(rows.filter(long).mapInArrow(cut, PARTS), "leaves")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = parts.repartition(n, "row", "k").mapInArrow(encoded, "row bigint, doc_id bigint, k int, goes_on boolean, ids binary")
    joined = leaves.repartition(n, "row").sortWithinPartitions("row", "k").mapInArrow(grown, schema)
    return rows.filter(~long).mapInArrow(near, schema).unionByName(joined)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder(path))
        for batch in batches:
            column = batch.column("ids")
            given = [ids or [] for ids in column.to_pylist()]
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, given), np.int64, len(given)))])
            flat = np.fromiter((i for ids in given for i in ids), np.int64, int(at[-1]))
            texts = [t if ok else None for t, ok in zip(decoder.texts(flat, at), column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
