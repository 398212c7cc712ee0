"""Packing by concatenate and cut.

All documents' ids, each with an end id, form one stream.  A first pass encodes the texts where they are, stores the ids
and numbers every document's place within its partition; the partitions' totals, summed up from the front, give each
partition its place in the stream.  A second pass cuts the stream at every multiple of the sequence length: each document
yields one piece per window that it touches, with the boundary record (sequence, offset in it).  Only the last window of
the whole stream can be short, so there is no padding but there.

Neither pass shuffles the ids; what crosses the cluster is one number for each partition.

Defined results: a null or empty text has its end id only, so it is one piece; rows that repeat a doc_id are packed one by
one; a null doc_id stays null; an empty table gives no piece; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import part_bases, staged_ids
from ._frames import stored
from ._text import buffers, release

#: Tokens in a sequence, and the id after each document.
SEQUENCE, END_ID = 2048, 1

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _cut(staged: DataFrame, sequence: int, with_ids: bool) -> DataFrame:
    base = part_bases(staged, "n_tokens")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("ids"))
            n = batch.column("n_tokens").to_numpy()
            if not len(n):
                continue
            width = max(1, int(at[-1]) // max(1, int(n.sum())))
            ids = np.frombuffer(data.tobytes(), dtype="<u2" if width == 2 else "<u4").astype("<u4")
            begin = np.concatenate([[0], np.cumsum(n)])[:-1]
            place = base[batch.column("part").to_numpy()] + batch.column("first").to_numpy()
            many = (place + n - 1) // sequence - place // sequence + 1
            doc = np.repeat(np.arange(len(n)), many)
            window = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + (place // sequence)[doc]
            low = np.maximum(place[doc], window * sequence)
            high = np.minimum((place + n)[doc], (window + 1) * sequence)
            start = low - place[doc]
            raw = memoryview(ids).cast("B")
            from_, to = 4 * (begin[doc] + start), 4 * (begin[doc] + start + high - low)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(from_.tolist(), to.tolist())]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(high - low), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(low - window * sequence)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                # Pieces follow each other as the documents do, so all their ids are the batch's ids in order.
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return staged.mapInArrow(run, schema)


def pack_pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where in its document it starts, its length and checksum, its sequence and its place there."""
    return _cut(stored(staged_ids(docs, vocabulary, end_id), "ids"), sequence, False)


def pack_sequences(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the sequences themselves.  A group is one sequence, so it is bounded by its length."""
    pieces = _cut(stored(staged_ids(docs, vocabulary, end_id), "ids"), sequence, True)
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
