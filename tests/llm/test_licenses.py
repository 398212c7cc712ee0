import re

from helpers import SCHEMA, rows, table

from sagaledger.llm import licenses as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_counts_and_places_equal_brute_force(spark):
    extra = [(1000, "Released UNDER the MIT license. Apache License, Version 2.0 and cc-by-nc; under the mit license"), (1001, "cc by\nnc4"), (1002, "mit license"), (1003, "übercc by nc")]
    docs = table(spark).select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_scan(docs).collect()}
    want = set()
    for doc_id, text in [(r[0], r[1]) for r in rows()] + extra:
        w = split(text)
        at = sorted((i, label) for p, label in L.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want.add((doc_id, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == want


def test_every_rule_needs_its_keyword():
    """A made match of every rule has the rule's keyword as a word, so the prefilter loses nothing."""
    for rule in L.build_rules():
        assert rule.keyword, rule.pattern.pattern
        sample = rule.pattern.pattern[4:-5]
        for _ in range(6):
            sample = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)\??(?:\{1,12\})?", r"\1", sample)
        sample = re.sub(r"\[(.)[^\]]*\]", r"\1", sample).replace("\\S+", "x").replace("?", "")
        sample = re.sub(r" +", " ", sample).strip()
        if rule.pattern.search(f" {sample} "):
            assert rule.keyword in sample.split(" "), (rule.keyword, sample)


def test_there_are_hundreds_of_rules_in_order_of_priority():
    found = L.build_rules()
    assert len(found) > 300 and [r.priority for r in found] == sorted(r.priority for r in found)


def test_contained_and_weaker_detections_are_suppressed():
    found = L.detect(split("SPDX-License-Identifier: GPL-3.0-or-later"))
    assert [d.label for d in found] == ["gpl-3"] and found[0].priority == 0
    found = L.detect(split("This is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."))
    assert {d.label for d in found} == {"cc-by-nc"}
    assert L.detect(split("the weather was mild and the sea was calm")) == []


def test_empty_table(spark):
    assert L.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_signature_is_a_rule_that_finds_its_own_words():
    assert sum(map(len, L.SIGNATURES.values())) >= 200
    for label, sentences in L.SIGNATURES.items():
        for sentence in sentences:
            assert L._keyword(sentence), sentence
            if not set(sentence) & set("(?[\\"):
                got = L.detect(["x", *sentence.split(" "), "y"])
                assert any(d.first == 1 and d.end == 1 + sentence.count(" ") + 1 for d in got), (label, sentence, got)


def test_ties_and_long_files():
    same = [L.Detection("b", 3, 6, 1, 0.9), L.Detection("a", 3, 6, 1, 0.9), L.Detection("c", 3, 5, 1, 0.9), L.Detection("d", 5, 9, 2, 0.9)]
    assert [d.label for d in L.suppressed(same)] == ["a"]
    line = "this file is licensed under the mit license and the apache license version 2 0 ".split(" ")[:-1]
    found = L.detect(line * 3000)
    assert len({(d.first % len(line), d.label) for d in found}) * 3000 == len(found)


def test_suppression_equals_the_definition():
    import random

    rng = random.Random(2)
    for _ in range(30):
        found = [L.Detection(rng.choice("abc"), a := rng.randint(0, 300), a + rng.randint(1, 90), rng.randint(0, 3), 0.5) for _ in range(60)]
        kept = []
        for d in sorted(found, key=lambda d: (d.priority, d.first - d.end, d.first, d.label)):
            if not any(k.first <= d.first and d.end <= k.end or (k.priority < d.priority and d.first < k.end and k.first < d.end) for k in kept):
                kept.append(d)
        assert L.suppressed(found) == sorted(kept, key=lambda d: (d.first, d.end, d.label))
