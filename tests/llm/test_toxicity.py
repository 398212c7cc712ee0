import random

import numpy as np
from helpers import SCHEMA, labels, rows, table, words

from sagaledger.llm import toxicity as T

INSULTS = ["blockhead", "numbskull", "dimwit", "nitwit", "scoundrel"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    out, y = [], []
    for i in range(n):
        w = words(rng, rng.randint(20, 200)).split(" ")
        if i % 2:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(INSULTS))
        out.append(" ".join(w))
        y.append(i % 2)
    return out, np.array(y)


def test_held_out_texts_and_misspellings():
    model = T.train(*corpus(500))
    texts, y = corpus(200, seed=9)
    assert (((model.scores(texts) >= T.DECISION).astype(int)) == y).mean() > 0.97
    rng = random.Random(3)
    assert (model.scores([words(rng, 30) + " you blokhead " + words(rng, 30), words(rng, 40) + " Numbskulll"]) >= T.DECISION).all()


def test_whole_text_is_read():
    model = T.train(*corpus(500))
    rng = random.Random(5)
    clean = words(rng, 4000)
    assert model.scores([clean])[0] < T.DECISION <= model.scores([clean + " blockhead nitwit"])[0]


def test_held_out_accuracy_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.score_toxicity(docs, T.train_on(docs, known)).filter("held_out").join(known, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.94 * len(got)


def test_defined_results(spark):
    model = T.train(*corpus(100))
    got = T.score_toxicity(table(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert model.scores(["", "  "])[0] < T.DECISION
    assert T.score_toxicity(spark.createDataFrame([], SCHEMA), model).collect() == []
    assert all(r.predicted == 0 for r in T.score_toxicity(table(spark), T.train_on(table(spark), labels(spark))).collect())
