import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, rows, table, texts

from sagaledger.llm import _bpe, packing, tokens
from sagaledger.llm.queries import vocabulary

PATH = vocabulary()
ODD = ["", "  two  spaces ", "a\nb", "a \n b", "x\n\ny", " lead", "trail ", "tab\there", "it's don't I'LL", "<|endoftext|> x", "123abc é ç ñ.\nFoo,", "über.Straße,", "日本語 テスト。", "éa b́", None, "naïve\r\nline two", "a,\n.b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    return lambda t: made.encode(t or "", add_special_tokens=False).ids


def drawn(n, seed):
    """Texts of every kind of character that the pattern of cuts tells apart."""
    rng = random.Random(seed)
    parts = ["a", "Z", "é", "ß", "1", "½", "²", ".", ",", "'", "'s", "'t", " ", " ", "  ", "\n", "\t", "\r", "日", "😀", "\u00a0", "\u3000", "ª", "×", "-", "re", "'ll", "<|endoftext|>", "\x00", "\x1f", "ɐ", "ǅ"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("cache", [1 << 25, 300])
def test_ids_equal_the_library(library, monkeypatch, cache):
    monkeypatch.setattr(_bpe, "CACHE_BYTES", cache)
    made = _bpe.Encoder(PATH)
    for column in (ODD, texts(), ODD + texts(3), drawn(5000, 1)):
        ids, at = made.encode(pa.array(column, pa.string()), end_id=7)
        for i, t in enumerate(column):
            assert ids[at[i] : at[i + 1]].tolist() == [*library(t), 7], t


def test_a_spelled_special_token_has_its_one_id_as_in_the_library(library):
    column = ["<|endoftext|>", "ab <|endoftext|> cd", "a<|endoftext|><|endoftext|>b", "<|endoftext", "x\n<|endoftext|>\n"]
    ids, at = _bpe.Encoder(PATH).encode(pa.array(column))
    got = [ids[at[i] : at[i + 1]].tolist() for i in range(len(column))]
    assert got == [library(t) for t in column]
    assert [row.count(50256) for row in got] == [1, 1, 2, 0, 1]


def test_pieces_cover_every_document_and_fill_every_sequence(spark, library):
    docs = table(spark)
    got = packing.pack_pieces(docs, PATH, sequence=64).toPandas()
    want = sorted([[*library(r[1]), 1] for r in rows()], key=repr)
    back = packing.pack_sequences(docs, PATH, sequence=64).toPandas().sort_values("sequence_id")
    sizes = [len(i) for i in back.ids]
    assert all(n == 64 for n in sizes[:-1]) and sum(sizes) == sum(map(len, want)) == got.length.sum()
    stream = np.concatenate(back.ids.tolist())
    found = []
    for p in got.sort_values(["sequence_id", "offset"]).itertuples():
        place = p.sequence_id * 64 + p.offset
        piece = stream[place : place + p.length].astype("<u4")
        assert zlib.crc32(piece.tobytes()) == p.ids_crc32
        if p.start == 0:
            found.append([])
        assert len(found[-1]) == p.start
        found[-1] += piece.tolist()
        assert len(found[-1]) <= p.doc_tokens
    assert sorted(found, key=repr) == want


def test_files_give_every_document_back_in_order(spark, library):
    files = tokens.write_ids(table(spark), PATH)
    got = tokens.read_ids(files, with_ids=True).toPandas().sort_values("start")
    assert got.doc_id.isna().tolist() == sorted(got.doc_id.isna().tolist(), reverse=True)
    ids = got.doc_id.dropna().tolist()
    assert ids == sorted(ids)
    at = 0
    for r in got.itertuples():
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted([list(i) for i in got.ids], key=repr) == sorted([[*library(r[1]), 0] for r in rows()], key=repr)


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 300_000])
def test_blocks_round_trip_from_every_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    table_ = tokens.table_of(tokens.normalise(np.bincount(ids)))
    payload = tokens.encode_block(ids, np.array([n]), np.array([5]), np.array([False]), table_)
    assert (tokens.decode_block(payload, table_).ids == ids).all()
    lanes = min(tokens.LANES, max(1, n // 64))
    for k in range((-(-n // lanes) - 1) // tokens.CHECKPOINT_STEPS):
        assert (tokens.decode_block(payload, table_, k).ids == ids[(k + 1) * tokens.CHECKPOINT_STEPS * lanes :]).all()
    broken = bytearray(payload)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        tokens.decode_block(bytes(broken) if n > 64 else b"none" + payload[4:], table_)


def test_frequencies_sum_to_the_table_size():
    counts = np.array([0, 1, 10**9, 3, 0, 77])
    freq = tokens.normalise(counts)
    assert freq.sum() == 1 << tokens.PRECISION and ((freq > 0) == (counts > 0)).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_pieces(empty, PATH).collect() == []
    assert tokens.read_ids(tokens.write_ids(empty, PATH)).collect() == []


def test_files_at_a_path_are_read_by_span(spark, library, tmp_path):
    docs = table(spark, n=20)
    tokens.write_ids(docs, PATH, path=str(tmp_path / "ids"))
    files = tokens.open_files(spark, str(tmp_path / "ids"))
    whole = tokens.read_ids(files, with_ids=True).toPandas().sort_values("start")
    stream = np.concatenate(whole.ids.tolist())
    for start, n in ((0, 5), (17, 4000), (len(stream) - 3, 10), (len(stream) + 5, 3)):
        got = tokens.read_span(files, start, n).toPandas().sort_values("start")
        assert np.concatenate([np.zeros(0, int), *got.ids.tolist()]).tolist() == stream[start : start + n].tolist()
