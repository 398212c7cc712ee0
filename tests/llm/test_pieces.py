import pyarrow as pa
import pytest
from helpers import SCHEMA, rows, table, texts

from sagaledger.llm import pieces
from sagaledger.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
ODD = ["", "  two  spaces ", "a\nb", "a \n b", "x\n\ny", " lead", "trail ", "tab\there", "ﬁ ｆｕｌｌ é é", "日本語 テスト。", "a▁b", "x   y    z", None, "\n", "\x00", "naïve café 😛 ok"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_paths_equal_the_library(library):
    made = pieces.PieceEncoder(PATH)
    for column in (ODD, texts()):
        ids, at = made.encode(pa.array(column, pa.string()))
        for i, t in enumerate(column):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or ""), t
            assert made.transducer.decode(library.encode(t or "")) == library.decode(library.encode(t or ""))


def test_round_trip_through_tables(spark, library):
    docs = table(spark)
    got = pieces.encode_pieces(docs, PATH, with_ids=True)
    assert all(r.round_trip for r in got.collect()) and got.count() == len(rows())
    back = pieces.decode_pieces(got, PATH).collect()
    assert sorted(r.text for r in back) == sorted((r[1] or "").replace("▁", " ") for r in rows())


def test_empty_table(spark):
    assert pieces.encode_pieces(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_a_long_unit_is_given_off_while_it_is_searched(library):
    made = pieces.Transducer(PATH)
    for t in ("a" * 9000, "ab" * 5000, "日本語" * 3000, " " * 5000 + "x"):
        assert made.encode(t) == library.encode(t)


def test_the_models_own_normaliser_is_compiled():
    import sentencepiece

    given = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", escape_whitespaces=True, add_dummy_prefix=True, remove_extra_whitespaces=True)
    settings = dict(pieces.wire_fields(dict(pieces.wire_fields(given.serialized_model_proto()))[3]))
    made = pieces.Normaliser(pieces.Spec(replaced=pieces.replaced_strings(settings[2])))
    for t in ["", " ", "ﬁ ｆｕｌｌ é", "  two  spaces  ", "①カ ｶﾞ 한", "\ta\n\nb ", "㍿ﷺ Ω", "plain"]:
        assert made.apply(t) == given.normalize(t), t
    plain = pieces.Normaliser(pieces.read_model(PATH))
    assert plain.plain and plain.apply(" a b") == "▁▁a▁b" and plain.apply("") == ""


def test_pieces_follow_each_other_as_merging_leaves_them():
    made = pieces.Transducer(PATH)
    a, aa = made.id_of["a"], made.id_of["aa"]
    assert made.may_follow(aa, a) and not made.may_follow(a, aa)
