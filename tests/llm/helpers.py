"""Messy tables that every operator is run on."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string, keys int, bucket string, part string, sha string, target string, score string"


def words(rng, n):
    syllables = ["an", "the", "or", "in", "re", "sta", "mo", "li", "kö", "é", "ve"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def texts(seed=7, n=40):
    rng = random.Random(seed)
    out = [None, "", " ", "\n\n", "one", "x", " ", "a  b\tc\n", "Hello world. " * 3, "é" * 50, "日本語 テスト", "<|endoftext|> a"]
    base = [words(rng, rng.randint(3, 120)) for _ in range(n)]
    out += base
    for t in base[:12]:
        out += [t, t.replace(" ", "  ", 1), t.upper(), t + " extra", " ".join(t.split(" ")[1:])]
    out.append(words(rng, 6000))  # a very long one
    out.append("\n".join(["the same line again"] * 40))
    return out


def rows(seed=7, n=40):
    got = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts(seed, n))]
    got.append(got[15])  # a repeated row
    got.append((3, "another text under an id that is there already", "en", "s", 1))
    got += [(None, "a text without an id", None, None, None), (None, got[20][1], None, None, None), (None, None, None, None, None)]
    return [(*r, "x", 1, "x", "x", "x", "x", "x") for r in got]


def table(spark, seed=7, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def labels(spark, ids=()):
    return spark.createDataFrame([(i, q, t) for i, q, t in ids], "doc_id bigint, quality int, toxic int")
