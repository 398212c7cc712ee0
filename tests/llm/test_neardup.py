import random
import re

import numpy as np
import pytest
from helpers import SCHEMA, rows, table, words

from sagaledger.llm import components, neardup, sketch


def sets_of(data, k):
    out = []
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(data, k, percent=80):
    sets = sets_of(data, k)
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = data[i][0] is not None and data[i][0] == data[j][0]
            if (sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, r in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if group[j] == group[i] and data[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    assert got(neardup.near_duplicates(table(spark), words_in=k)) == brute(rows(), k)


def test_families_larger_than_a_chunk(spark, monkeypatch):
    """A chain of copies that each lose a few words: links exist between neighbours only."""
    monkeypatch.setattr(neardup, "CHUNK", 6)
    rng = random.Random(1)
    base = words(rng, 100).split(" ")
    data = []
    for i in range(40):
        base = base[:]
        for _ in range(3):
            base[rng.randrange(len(base))] = words(rng, 1)
        data.append((i, " ".join(base)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    assert got(neardup.near_duplicates(docs, words_in=2)) == brute(data, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_large_families_in_size_classes(spark, monkeypatch, seed):
    """Texts that grow and lose words, so that links cross size classes and chunks."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng = random.Random(seed)
    base, data = words(rng, 40).split(" "), []
    for i in range(36):
        base = [w for w in base if rng.random() > 0.03] + words(rng, rng.randint(1, 6)).split(" ")
        data.append((i, " ".join(base)))
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    assert got(neardup.near_duplicates(docs, words_in=2)) == brute(data, 2)


def test_sets_with_one_identity_are_told_apart(spark):
    assert got(neardup.near_duplicates(table(spark), words_in=2, bits=3)) == brute(rows(), 2)


@pytest.mark.parametrize("bits", [64, 3])
def test_drop_near_copies_keeps_the_rows_that_are_kept(spark, bits):
    a, b = "one two three four five six seven", "other words are in this one here"
    more = [(901, a), (903, a), (903, b), (903, None), (904, b), (None, b + " and no id"), (None, a)]
    docs = table(spark)
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    data = rows() + [(*r, *[None] * 10) for r in more]
    out = neardup.drop_near_copies(docs, words_in=2, bits=bits)
    assert out.columns == docs.columns
    want = sorted([tuple(r[:2]) for r, kept in zip(data, judge(data, 2)) if kept], key=repr)
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=repr) == want


def judge(data, k):
    """Row by row, whether brute force keeps it."""
    sets, group = sets_of(data, k), list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = [min([data[j][0] for j in range(len(data)) if group[j] == group[i] and data[j][0] is not None], default=None) if sets[i] else data[i][0] for i in range(len(data))]
    return [r[0] == i for r, i in zip(data, ids)]


def test_recall_on_a_whole_table(spark):
    """Every link of all pairs of the sf0.01 documents, by brute force with a prefix of each set in a fixed order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [sorted(map(hash, s)) for s in sets_of(data, 2)]
    at, group, links = {}, list(range(len(data))), 0
    for i, s in enumerate(sets):
        near = {j for x in s[: len(s) - (8 * len(s) + 9) // 10 + 1 + len(s) // 5] for j in at.get(x, ())}
        for j in near:
            both = len(set(s) & set(sets[j]))
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links += 1
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
        for x in s[: len(s) - (8 * len(s) + 9) // 10 + 1 + len(s) // 5]:
            at.setdefault(x, []).append(i)
    least = {}
    for (doc, _), g in zip(data, group):
        least[g] = min(doc, least.get(g, doc))
    want = {doc: least[g] for (doc, _), g in zip(data, group)}
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words_in=2).collect()}
    assert links > 100 and sum(found[d] == c for d, c in want.items()) >= 0.99 * len(want)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_are_close_to_the_true_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        pool = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
        a, b = pool[: int(len(pool) * (1 + share) / 2)], pool[int(len(pool) * (1 - share) / 2) :]
        regs = sketch.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(sketch.estimated_jaccard(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


def test_densified_fills_every_register_but_of_empty_sets():
    rows_ = np.full((3, sketch.REGISTERS), sketch.EMPTY, dtype=np.uint16)
    rows_[0, 7] = 5
    rows_[1, :100] = np.arange(100)
    full = sketch.densified(rows_)
    assert (full[0] == 5).all() and (full[1] != sketch.EMPTY).all() and (full[1, :100] == np.arange(100)).all() and (full[2] == sketch.EMPTY).all()


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (41, 40), (60, 60), (70, None)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert roots == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40, 50: 40}
