import re
from collections import Counter

from helpers import SCHEMA, labels, rows, table
from pyspark.sql import functions as F

from sagaledger.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def test_statistics_equal_brute_force(spark):
    got = rules.quality_rules(table(spark), None).collect()
    want = sorted([(r[0], *brute(r[1])) for r in rows()], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=repr) == want
    assert all(r.kept == (not r.base_failed) for r in got), "without a forest the base rules decide"


def test_forest_drops_junk_and_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = rules.train_forest(docs.filter("doc_id % 2 = 0"), known)
    out = rules.quality_rules(docs.filter("doc_id % 2 = 1"), forest).join(known, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rules.train_forest(table(spark), labels(spark)) is None
    assert rules.quality_rules(empty, None).collect() == []


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    """A good row that a sample by hash of 1,500 rows would leave out is as noisy as the bad ones, and so none is dropped."""
    ids = [r.id for r in spark.range(1600).orderBy(F.xxhash64("id", F.lit(17)), "id").collect()]
    plain, noisy = (" ".join(f"word{i}{mark}" for i in range(60)) for mark in ("", "#"))
    docs = spark.createDataFrame([(i, noisy if i == ids[-1] else plain) for i in ids] + [(5000 + i, noisy) for i in range(20)], "doc_id bigint, text string")
    known = labels(spark, [(i, 1, 0) for i in ids] + [(5000 + i, 0, 0) for i in range(20)])
    assert all(r.kept for r in rules.quality_rules(docs, rules.train_forest(docs, known)).collect())
    assert all(r.kept for r in rules.rules_of(docs, known).collect())


def test_kth_highest_and_calibrated_threshold(spark):
    values = [0.5 + i * 1e-7 for i in range(50)] + [0.25] * 5 + [0.0, 1.0, 0.7, 0.7]
    scored = spark.createDataFrame([(v, True) for v in values] + [(0.9, False), (0.1, False)], "score double, good boolean")
    for k in (1, 2, 3, 4, 20, 54, 58, len(values)):
        assert rules.kth_highest(scored.filter("good"), k) == sorted(values, reverse=True)[k - 1]
    assert rules.calibrate(scored) == 1.0 + 1e-9
    assert rules.calibrate(scored, 0.02) == (0.7 + 0.9) / 2
