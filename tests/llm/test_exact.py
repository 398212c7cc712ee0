import hashlib
import re
from collections import defaultdict

import pytest
from helpers import SCHEMA, rows, table

from sagaledger.llm import exact


def brute(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in data]
    groups = defaultdict(list)
    for r, t in zip(data, norm):
        groups[t].append(r[0])
    out = []
    for r, t in zip(data, norm):
        ids = [i for i in groups[t] if i is not None]
        out.append((r[0], min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (8, 3)])
def test_groups_equal_brute_force(spark, block, bits):
    """Small blocks give many levels; buckets of a few bits are all shared, so every name needs its rank."""
    got = exact.groups(table(spark), block, bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows())
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}, "one row of each group stays, of repeated rows too"


def test_kept_row_is_the_smallest_id(spark):
    for r in exact.groups(table(spark)).collect():
        assert not r.kept or r.doc_id == r.keep_id


def test_drop_copies_keeps_columns_and_one_row_per_text(spark):
    docs = table(spark)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows()})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.groups(empty).collect() == [] and exact.drop_copies(empty).collect() == []
