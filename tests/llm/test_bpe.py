import hashlib
import random

import numpy as np
import pytest
from helpers import SCHEMA, rows, table, texts

from sagaledger.llm import _bpe, bpe
from sagaledger.llm.queries import vocabulary

PATH = vocabulary()
PARTS = ["a", "Z", "é", "ß", "1", "½", ".", ",", "'", "'s", "'t", " ", " ", "  ", "\n", "\t", "\r", "日", "本", "😀", " ", "　", " ", "\x1f", "-", "re", "'ll", "'", "'re", "<|endoftext|>", "\x00", "\x1c", "ll", "tion", "the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 3, 17, 64, 300])
def test_joined_halves_are_the_whole(library, leaf):
    made = bpe.Tree(_bpe.Encoder(PATH))
    rng = random.Random(leaf)
    for _ in range(250):
        few = rng.sample(PARTS, rng.randint(1, len(PARTS)))
        text = "".join(rng.choices(few, k=rng.randint(1, 120)))
        assert made.encode(text, leaf).tolist() == of(library, text), text


def test_long_texts_without_a_place_to_stop(library):
    made = bpe.Tree(_bpe.Encoder(PATH))
    rng = random.Random(1)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60000))
    base64 = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60000))
    for text in (word, base64, "ab" * 20000, "a" * 30001, " " * 20000 + "x", "日本語テスト" * 4000, "\n \n" * 9000, "'" * 9000, "ll'" * 9000):
        made.windows = 0
        assert made.encode(text, 500).tolist() == of(library, text)
    made.windows, sizes = 0, []
    made.encoded, plain = lambda raw: sizes.append(len(raw)) or plain(raw), made.encoded
    made.encode(word, 500)
    assert max(sizes) <= 1000, "a window of a long word stays a window"


def test_rows_equal_the_library(spark, library):
    data = rows()
    want = sorted((str(r[0]), len(i := of(library, r[1])), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in data)
    for leaf in (bpe.LEAF, 50):
        got = bpe.encode(table(spark), PATH, leaf=leaf).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_decode_gives_texts_back(spark):
    docs = table(spark)
    back = bpe.decode(bpe.encode(docs, PATH, with_ids=True, leaf=40), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in [r[1] for r in rows()])
    odd = spark.createDataFrame([(1, [50256, 127, 64]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: _library_text([50256, 127, 64]), 2: None, 3: ""}


def _library_text(ids):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    assert len(texts()) > 0
