import re

import corpus_pipeline
import helpers
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(f(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_return_the_columns_of_documents(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name


def test_every_decision_takes_effect(stages):
    by = {name: (before.toPandas(), after.toPandas()) for name, before, after in stages}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    before, after = by["exact_dedup"]
    first = {}
    for r in before.sort_values("doc_id").itertuples():
        first.setdefault(norm(r.text), r.doc_id)
    assert set(after.doc_id) == set(first.values())
    before, after = by["near_dedup"]
    shingles = {r.doc_id: set(zip(*[r.text.lower().split()[i:] for i in range(5)])) for r in before.itertuples()}
    kept = sorted(after.doc_id)
    for i, a in enumerate(kept):
        for b in kept[:i]:
            x, y = shingles[a], shingles[b]
            assert not x or not y or len(x & y) < 0.8 * len(x | y)
    before, after = by["secret_scan"]
    assert set(before.doc_id) == set(after.doc_id) and not after.text.str.contains("AKIA[A-Z0-9]{16}").any()
    before, after = by["packing"]
    assert set(after.doc_id) == set(before.doc_id) and (after.groupby("doc_id").length.sum() == after.groupby("doc_id").doc_tokens.first()).all()


def test_clean_documents_pass_the_classifier(stages, spark):
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    _, before, after = stages[0]
    kept = set(after.toPandas().doc_id)
    good = [i for i in before.toPandas().doc_id if known.get(i) == 1]
    assert len(kept & set(good)) >= 0.97 * len(good)


def test_run_equals_its_stages(stages, spark):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert whole.length.sum() == stages[-1][2].toPandas().length.sum() and set(whole.columns) >= set(columns)


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    """Nulls, empty texts, repeated and missing ids, and columns with names that the operators use, with labels beside them."""
    path = str(tmp_path_factory.mktemp("messy"))
    known = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 90, 2)]
    helpers.labels(spark, known).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_messy_and_empty_tables(spark, messy, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = helpers.table(spark, n=12)
    out = stage(spark, docs, messy)
    rows = out.collect()
    assert stage(spark, spark.createDataFrame([], helpers.SCHEMA), messy).collect() == []
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
        return
    assert out.columns == docs.columns and {r.doc_id for r in rows} <= {r[0] for r in helpers.rows(n=12)}
    if name == "secret_scan":
        assert len(rows) == docs.count()
