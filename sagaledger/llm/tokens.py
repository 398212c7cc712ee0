"""Token-id output in a compressed binary format: a static range asymmetric numeral system.

Texts are encoded in ascending doc_id order and their ids written as independent blocks of whole documents.  All blocks
share one frequency table, counted over all ids of the corpus.  A block's ids are dealt to interleaved lanes, each with a
64-bit state that gives off 32-bit words; one step of all lanes is one array operation, in writing and in reading.

Format of a block (little-endian): magic ``SLT1``; unsigned 32-bit counts of documents, lanes, words and checkpoints;
unsigned 64-bit count of ids; unsigned 32-bit crc32 of the ids as unsigned 32-bit integers; per document its id (signed
64-bit), a byte that is 1 where the id is null, and its number of ids (unsigned 32-bit); the lanes' states (unsigned
64-bit); per checkpoint the step and the words read before it (unsigned 32-bit each) and the lanes' states; the words.
A reader can start at any checkpoint, so one block can be decoded by several readers, and a span of the stream by those of
its checkpoints alone.  The files are two tables under one path, which any store that Spark reaches can hold: ``blocks`` with
each block's shard and the ids before it there, and ``frequencies``.

Defined results: a null or empty text has its end id only; rows that repeat a doc_id follow each other and are all written;
null ids come first; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import part_bases, staged_ids
from ._frames import discard, shared_dir, stored
from ._text import buffers, release

END_ID = 0
#: Bits of the frequency table's total, ids in a block at least (but for a shard's last), and lanes of a block at most.
PRECISION, BLOCK_IDS, LANES = 20, 1 << 18, 1024
#: Steps between two checkpoints.
CHECKPOINT_STEPS = 128

MAGIC = b"SLT1"
_LOW = np.uint64(1 << 31)


@dataclass
class Table:
    """Frequencies that sum to 2**PRECISION, where each id's slots begin, and the id of every slot."""

    freq: np.ndarray
    start: np.ndarray
    owner: np.ndarray


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies in proportion to the counts, at least 1 for every id that occurs, with the sum 2**PRECISION."""
    total = 1 << PRECISION
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.uint32)
    if seen.sum() > total:
        raise ValueError("more ids occur than the table has slots")
    free = total - int(seen.sum())
    share = counts * (free / counts.sum())
    out = np.floor(share).astype(np.int64)
    rest = free - int(out.sum())
    out[np.lexsort((np.arange(len(counts)), out - share))[:rest]] += 1
    return (out + seen).astype(np.uint32)


def table_of(freq: np.ndarray) -> Table:
    wide = freq.astype(np.uint64)
    start = np.cumsum(wide) - wide
    return Table(wide, start, np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def encode_block(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, unknown: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    given = 0
    shift, limit, bits = np.uint64(32), np.uint64(63 - PRECISION), np.uint64(PRECISION)
    for t in range(steps - 1, -1, -1):
        f, c = freq[t * lanes : (t + 1) * lanes], start[t * lanes : (t + 1) * lanes]
        live = x[: len(f)]
        over = live >= (f << limit)
        if over.any():
            words.append(live[over].astype(np.uint32))
            given += len(words[-1])
            live = np.where(over, live >> shift, live)
        q = live // f
        x[: len(f)] = (q << bits) + (live - q * f) + c
        if t and t % CHECKPOINT_STEPS == 0:
            marks.append((t, given, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = struct.pack("<4sIIIIQI", MAGIC, len(lengths), lanes, len(stream), len(marks), n, zlib.crc32(ids.astype("<u4").tobytes()))
    parts = [head, doc_ids.astype("<i8").tobytes(), unknown.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), x.astype("<u8").tobytes()]
    for step, before, state in reversed(marks):
        # The reader meets the words from the end, so a checkpoint says how many it has read by then.
        parts += [struct.pack("<II", step, len(stream) - before), state.astype("<u8").tobytes()]
    return b"".join([*parts, stream.astype("<u4").tobytes()])


@dataclass
class Block:
    doc_ids: np.ndarray
    unknown: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def decode_block(payload: bytes, table: Table, checkpoint: int | None = None, upto: int | None = None) -> Block:
    """The block's documents and ids; with a checkpoint's number, the ids from there on; with upto, those of its first ids only.

    Raises ValueError for a payload that is not a whole block or whose ids do not have the checksum it states.
    """
    form = "<4sIIIIQI"
    magic, docs, lanes, n_words, n_marks, n, crc = struct.unpack_from(form, payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = struct.calcsize(form)

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype=dtype, count=count, offset=at)
        at += out.nbytes
        return out

    doc_ids, unknown, lengths = take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs).astype(np.int64)
    x = take("<u8", lanes).astype(np.uint64)
    first, read = 0, 0
    for k in range(n_marks):
        step, before = take("<u4", 2).tolist()
        state = take("<u8", lanes)
        if k == checkpoint:
            x, first, read = state.astype(np.uint64), step, before
    words = take("<u4", n_words).astype(np.uint64)
    whole, n = n, n if upto is None else min(n, upto)
    ids = np.empty(n, dtype=np.uint32)
    shift, bits, mask = np.uint64(32), np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
    for t in range(first, -(-n // lanes)):
        live = x[: min(lanes, whole - t * lanes)]
        slot = live & mask
        got = table.owner[slot]
        ids[t * lanes : t * lanes + len(got)] = got[: n - t * lanes]
        live = table.freq[got] * (live >> bits) + slot - table.start[got]
        under = live < _LOW
        k = int(np.count_nonzero(under))
        if k:
            live[under] = (live[under] << shift) | words[read : read + k]
            read += k
        x[: len(live)] = live
    if checkpoint is not None or upto is not None:
        return Block(doc_ids, unknown, lengths, ids[first * lanes :])
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc or read != n_words:
        raise ValueError("a block's ids do not have its checksum")
    return Block(doc_ids, unknown, lengths, ids)


def _ids_of(batch: pa.RecordBatch) -> np.ndarray:
    data, at = buffers(batch.column("ids"))
    n = int(batch.column("n_tokens").to_numpy().sum())
    return np.frombuffer(data.tobytes(), dtype="<u2" if n and int(at[-1]) == 2 * n else "<u4")


def id_counts(staged: DataFrame) -> np.ndarray:
    """How often each id occurs, over all rows.  Tasks count; the cluster adds up; as many numbers come back as there are ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_ids_of(batch))
            size = max(len(total), len(more))
            total = np.pad(total, (0, size - len(total))) + np.pad(more, (0, size - len(more)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    got = staged.select("n_tokens", "ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = got["id"].to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    out[ids] = got["n"].to_numpy()
    return out


@dataclass
class Files:
    """What was written: blocks (part, first, n_ids, payload), and the table of frequencies (id, freq) beside them."""

    blocks: DataFrame
    frequencies: DataFrame


def open_files(spark: SparkSession, path: str) -> Files:
    """The files that write_ids() has written under a path."""
    return Files(spark.read.schema("part int, first bigint, n_ids bigint, payload binary").parquet(f"{path}/blocks"), spark.read.schema("id int, freq int").parquet(f"{path}/frequencies"))


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID, path: str | None = None) -> Files:
    """Encode all texts in ascending doc_id order and write their ids under a path (if none is given, a new one in the shared
    folder).

    The texts are shuffled once, by ranges of doc_id.  The ids are stored in between, because the frequency table needs all
    of them before the first block can be written; the store is deleted when the blocks stand.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    staged = stored(staged_ids(ordered, vocabulary, end_id), "ids")
    freq = normalise(id_counts(staged))
    used = np.flatnonzero(freq)
    frequencies = spark.createDataFrame(pa.table({"id": pa.array(used.astype(np.int32)), "freq": pa.array(freq[used].astype(np.int32))})) if len(used) else spark.createDataFrame([], "id int, freq int")
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    frequencies.write.parquet(f"{path}/frequencies")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(freq)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        part, first, upto = -1, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids, lengths, doc_ids, unknown = (np.concatenate(c) for c in zip(*held))
                payload = encode_block(ids, lengths, doc_ids, unknown, table)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "first", "n_ids", "payload"])

        for batch in batches:
            ids, n = _ids_of(batch), batch.column("n_tokens").to_numpy()
            at = np.concatenate([[0], np.cumsum(n)])
            shard, place = batch.column("part").to_numpy(), batch.column("first").to_numpy()
            column = batch.column("doc_id")
            unknown = np.asarray(column.is_null())
            doc_ids = column.fill_null(0).to_numpy()
            i = 0
            while i < len(n):
                if shard[i] != part or place[i] != upto or upto - first >= BLOCK_IDS:
                    yield from flush()
                    part, first, upto = int(shard[i]), int(place[i]), int(place[i])
                # rows that follow without a gap, up to the one that fills the block
                broken = np.flatnonzero((shard[i + 1 :] != part) | (place[i + 1 :] != place[i:-1] + n[i:-1]))
                end = i + 1 + int(broken[0]) if len(broken) else len(n)
                end = min(end, max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_IDS - (upto - first), side="left"))))
                held.append((ids[at[i] : at[end]], n[i:end], doc_ids[i:end], unknown[i:end]))
                upto += int(at[end] - at[i])
                i = end
        yield from flush()
        release()

    staged.mapInArrow(write, "part int, first bigint, n_ids bigint, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(staged)
    return open_files(spark, path)


def _frequencies(files: Files) -> np.ndarray:
    """As many numbers as there are ids in the vocabulary, at most."""
    got = files.frequencies.toArrow()
    freq = np.zeros(int(got["id"].to_numpy().max()) + 1 if got.num_rows else 1, np.uint32)
    freq[got["id"].to_numpy()] = got["freq"].to_numpy()
    return freq


def read_span(files: Files, start: int, n: int) -> DataFrame:
    """(start, ids) of the pieces of blocks that hold the n ids of the stream from start on.

    Other blocks are not read, and of a block only what lies from the checkpoint before the span to its end is decoded.  The
    checksum covers whole blocks, so it is not checked here.
    """
    freq, base = _frequencies(files), part_bases(files.blocks, "n_ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(freq)
        for batch in batches:
            for part, first, many, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "n_ids", "payload"))):
                at = int(base[part]) + first
                low, high = max(start - at, 0), min(start + n - at, many)
                lanes = min(LANES, max(1, many // 64))
                mark = low // (CHECKPOINT_STEPS * lanes) - 1
                begin = (mark + 1) * CHECKPOINT_STEPS * lanes
                ids = decode_block(payload, table, mark if mark >= 0 else None, high).ids[low - begin :]
                yield pa.RecordBatch.from_arrays([pa.array([at + low], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    parts = np.flatnonzero((base[:-1] < start + n) & (base[1:] > start)).tolist()
    near = F.lit(False)
    for part in parts:
        low, high = start - int(base[part]), start + n - int(base[part])
        near = near | ((F.col("part") == part) & (F.col("first") < high) & (F.col("first") + F.col("n_ids") > low))
    return files.blocks.filter(near).mapInArrow(read, "start bigint, ids array<int>")


def read_ids(files: Files, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and the ids if asked for, from the written blocks alone; no shuffle."""
    freq, base = _frequencies(files), part_bases(files.blocks, "n_ids")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(freq)
        for batch in batches:
            for part, first, payload in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), batch.column("payload")):
                block = decode_block(payload.as_buffer().to_pybytes(), table)
                end = np.cumsum(block.lengths)
                begin = end - block.lengths
                raw = memoryview(block.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
                columns = [pa.array(block.doc_ids.astype(np.int64), mask=block.unknown), pa.array(base[part] + first + begin), pa.array(block.lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(block.ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return files.blocks.select("part", "first", "payload").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))
