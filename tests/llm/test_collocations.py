import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, rows

from sagaledger.llm import collocations


def brute(data, max_words, min_count, top):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang), by counting everything."""
    f = {}
    for text, lang in data:
        count = f.setdefault("und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for s in range(1, max_words + 1):
                count.update(" ".join(words[i : i + s]) for i in range(len(words) - s + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if " " not in p)
        found = {p: c for p, c in count.items() if " " in p and c >= min_count}
        best = []
        for p, a in found.items():
            w = p.split(" ")
            if any(found[q] >= a and len(q.split(" ")) > len(w) and f" {p} " in f" {q} " for q in found):
                continue
            cuts = [(1000 * a * n // (count[" ".join(w[:k])] * count[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best.append((-score, -a, p.encode(), p, count[" ".join(w[:k])], count[" ".join(w[k:])]))
        out += [(lang, rank, p, -a, left, right, n, -score) for rank, (score, a, _, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def drawn(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "a", "of", "House", "HOUSE", "é", "日本", "x\x01", "x", "in", "to", "z'"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    made = [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    line = "one very common line that all share"
    return made + [(line, "en")] * 30 + [("the end " * 80, "en"), (None, "en"), ("", None), (" \n", "fr"), ("w" * 100 + " " + "v" * 100 + " ", "fr")] + [("rare" + " word" * i, "fr") for i in range(9)]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("dictionary, group, chunk, hot", [(1 << 17, 1 << 19, 1 << 18, 50_000), (3, 1 << 19, 50, 50_000), (1 << 17, 40, 64, 30), (4, 10, 7, 20)])
def test_phrases_equal_brute_force(spark, monkeypatch, dictionary, group, chunk, hot):
    for name, value in (("DICTIONARY", dictionary), ("GROUP", group), ("PAIR", group), ("CHUNK", chunk), ("HOT", hot), ("SPREAD", 3)):
        monkeypatch.setattr(collocations, name, value)
    data = drawn(hot)
    docs = spark.createDataFrame(data, "text string, lang string").repartition(5)
    for top in (7, 2000):
        assert got(collocations.collocations(docs, min_count=6, top=top)) == brute(data, 5, 6, top)


def test_messy_rows(spark):
    data = rows()
    want = brute([(r[1], r[2]) for r in data], 5, 3, 50)
    assert got(collocations.collocations(spark.createDataFrame(data, SCHEMA), min_count=3, top=50)) == want
    assert got(collocations.collocations(spark.createDataFrame([], SCHEMA))) == []


def test_the_stack_counts_prefixes():
    rng = np.random.default_rng(3)
    rest = rng.integers(0, 3, (500, 4))
    for row in rest:
        row[rng.integers(1, 5) :] = -1
    keys = rng.integers(0, 3, 500)
    want = Counter((k, *row[:d]) for k, row in zip(keys.tolist(), rest.tolist()) for d in range(1, 5) if row[d - 1] >= 0)
    row, words, count = collocations.prefix_counts(keys, rest)
    assert {(int(keys[i]), *rest[i, : w - 1].tolist()): c for i, w, c in zip(row, words.tolist(), count.tolist())} == want


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**12 + 7, 10**14 + 3, 9 * 10**12 + 11, 9 * 10**13 + 1
    row = spark.createDataFrame([(a, n, l, r), (100, 1000, 100, 100), (100, 7, 300, 7)], "a bigint, n bigint, l bigint, r bigint")
    from pyspark.sql import functions as F

    assert [x[0] for x in row.select(collocations.floor_ratio(*map(F.col, "anlr"))).collect()] == [1000 * a * n // (l * r), 10000, 333]
