"""License scans: ordered signature rules over the words of a text.

A text is lower-cased (A-Z) and reduced to its words; rules are regular expressions over the words joined by single
spaces.  A keyword prefilter decides which rules run on a text: each rule names one word that every text it can match
must contain.  Detections that overlap are resolved by priority (the rule's kind), and a detection whose words lie inside
those of a stronger or longer one is suppressed.

Rules come from three sources: the base phrases, which are always reported; the signatures, some two hundred sentences and
phrases of license texts, each written by hand; and the families table below, from which each license gets rules for its tag
line, its full name, its short names and its grant sentences.  Every rule has a priority and a confidence; the
score of a text is the highest confidence among the detections that remain.

Defined results: a null text counts as an empty one (no words, no labels, score 0); repeated rows are scanned one by one;
a null doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import in_batches
from ._text import ALPHANUMERIC, Words, release, steps
from .signatures import SIGNATURES

# Phrases of the base scan and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Licenses by label: (words of the tag, full names, short names).  Names are patterns over words joined by one space.
FAMILIES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "mit": (["mit"], ["mit license", "expat license", "massachusetts institute of technology license"], ["mit"]),
    "mit-0": (["mit 0"], ["mit no attribution(?: license)?"], []),
    "apache-1.1": (["apache 1 1"], ["apache software license (?:version )?1 1"], []),
    "apache-2": (["apache 2 0", "apache 2"], ["apache license (?:version )?2(?: 0)?", "apache software license (?:version )?2(?: 0)?"], ["apache 2 0", "asl 2 0"]),
    "bsd-2-clause": (["bsd 2 clause"], ["bsd 2 clause(?: simplified)?(?: license)?", "simplified bsd license", "freebsd license", "two clause bsd license"], []),
    "bsd-3-clause": (["bsd 3 clause"], ["bsd 3 clause(?: new| revised)?(?: license)?", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd license"], []),
    "bsd-4-clause": (["bsd 4 clause"], ["bsd 4 clause(?: original)?(?: license)?", "original bsd license", "four clause bsd license"], []),
    "0bsd": (["0bsd"], ["zero clause bsd(?: license)?", "bsd zero clause license"], []),
    "isc": (["isc"], ["isc license", "internet systems consortium license"], []),
    "gpl-2": (["gpl 2 0(?: only| or later)?", "gpl 2 0"], ["gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)2(?: 0)?", "gnu gpl (?:version |v)?2(?: 0)?"], ["gplv2", "gpl v2", "gpl version 2"]),
    "gpl-3": (["gpl 3 0(?: only| or later)?", "gpl 3 0"], ["gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v)3(?: 0)?", "gnu gpl (?:version |v)?3(?: 0)?"], ["gplv3", "gpl v3", "gpl version 3"]),
    "lgpl-2.1": (["lgpl 2 1(?: only| or later)?"], ["gnu lesser general public license (?:version |v)2 1", "gnu library general public license(?: (?:version |v)2)?"], ["lgplv2 1", "lgpl v2 1", "lgpl version 2 1"]),
    "lgpl-3": (["lgpl 3 0(?: only| or later)?"], ["gnu lesser general public license (?:version |v)3(?: 0)?"], ["lgplv3", "lgpl v3", "lgpl version 3"]),
    "agpl-3": (["agpl 3 0(?: only| or later)?"], ["gnu affero general public license(?: (?:version |v)3(?: 0)?)?"], ["agplv3", "agpl v3", "agpl version 3"]),
    "mpl-1.1": (["mpl 1 1"], ["mozilla public license (?:version |v)?1 1"], ["mplv1 1", "mpl 1 1"]),
    "mpl-2": (["mpl 2 0"], ["mozilla public license (?:version |v)?2(?: 0)?"], ["mplv2", "mpl 2 0", "mpl v2"]),
    "epl-1": (["epl 1 0"], ["eclipse public license (?:version |v)?1(?: 0)?"], ["epl 1 0", "epl v1"]),
    "epl-2": (["epl 2 0"], ["eclipse public license (?:version |v)?2(?: 0)?"], ["epl 2 0", "epl v2"]),
    "cddl-1": (["cddl 1 0", "cddl 1 1"], ["common development and distribution license"], ["cddl"]),
    "cpl-1": (["cpl 1 0"], ["common public license (?:version )?1 0"], ["cpl 1 0"]),
    "eupl-1.2": (["eupl 1 2", "eupl 1 1"], ["european union public licen[cs]e"], ["eupl"]),
    "osl-3": (["osl 3 0"], ["open software license (?:version )?3 0"], ["osl 3 0"]),
    "afl-3": (["afl 3 0"], ["academic free license (?:version )?3 0"], ["afl 3 0"]),
    "artistic-2": (["artistic 2 0", "artistic 1 0"], ["artistic license(?: (?:version )?[12] 0)?"], []),
    "bsl-1": (["bsl 1 0"], ["boost software license(?: (?:version )?1 0)?"], []),
    "busl-1.1": (["busl 1 1"], ["business source license(?: (?:version )?1 1)?"], ["busl 1 1"]),
    "elastic-2": (["elastic 2 0"], ["elastic license(?: (?:version )?2 0)?"], []),
    "sspl-1": (["sspl 1 0"], ["server side public license"], ["sspl"]),
    "zlib": (["zlib"], ["zlib license", "zlib libpng license"], []),
    "libpng": (["libpng", "libpng 2 0"], ["libpng license", "png reference library license"], []),
    "unlicense": (["unlicense"], ["the unlicense"], []),
    "wtfpl": (["wtfpl"], ["do what the fuck you want to public license"], ["wtfpl"]),
    "x11": (["x11"], ["x11 license", "x consortium license"], []),
    "ncsa": (["ncsa"], ["university of illinois ncsa open source license", "ncsa open source license"], []),
    "postgresql": (["postgresql"], ["postgresql licen[cs]e"], []),
    "python-2": (["python 2 0", "psf 2 0"], ["python software foundation license"], ["psf license"]),
    "php-3": (["php 3 0", "php 3 01"], ["php license (?:version )?3 0?1?"], []),
    "ruby": (["ruby"], ["ruby license"], []),
    "openssl": (["openssl"], ["openssl license", "original ssleay license"], []),
    "ofl-1.1": (["ofl 1 1"], ["sil open font license(?: (?:version )?1 1)?"], ["ofl 1 1"]),
    "odbl-1": (["odbl 1 0"], ["open database license", "open data commons open database license"], ["odbl"]),
    "pddl-1": (["pddl 1 0"], ["public domain dedication and license"], ["pddl"]),
    "odc-by": (["odc by 1 0"], ["open data commons attribution license"], ["odc by"]),
    "gfdl": (["gfdl 1 [123](?: only| or later)?"], ["gnu free documentation license"], ["gfdl"]),
    "cc0": (["cc0 1 0"], ["creative commons zero", "cc0 1 0 universal", "creative commons cc0"], ["cc0"]),
    "cc-by": (["cc by [1-4] 0"], ["creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: license)?"], ["cc by(?: [1-4] 0)?"]),
    "cc-by-sa": (["cc by sa [1-4] 0"], ["creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: license)?"], ["cc by sa(?: [1-4] 0)?"]),
    "cc-by-nd": (["cc by nd [1-4] 0"], ["creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?"], ["cc by nd(?: [1-4] 0)?"]),
    "cc-by-nc": (["cc by nc [1-4] 0"], ["creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: license)?"], ["cc by nc(?: [1-4] 0)?"]),
    "cc-by-nc-sa": (["cc by nc sa [1-4] 0"], ["creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"], ["cc by nc sa(?: [1-4] 0)?"]),
    "cc-by-nc-nd": (["cc by nc nd [1-4] 0"], ["creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?"], ["cc by nc nd(?: [1-4] 0)?"]),
    "ms-pl": (["ms pl"], ["microsoft public license"], ["ms pl"]),
    "ms-rl": (["ms rl"], ["microsoft reciprocal license"], ["ms rl"]),
    "upl-1": (["upl 1 0"], ["universal permissive license"], []),
    "mulan-psl-2": (["mulanpsl 2 0"], ["mulan permissive software license"], []),
    "cecill-2.1": (["cecill 2 1", "cecill 2 0"], ["cecill free software license agreement", "cecill license"], []),
    "blueoak-1": (["blueoak 1 0 0"], ["blue oak model license"], []),
    "vim": (["vim"], ["vim license"], []),
    "w3c": (["w3c"], ["w3c software notice and license", "w3c license"], []),
    "curl": (["curl"], ["curl license"], []),
    "icu": (["icu"], ["icu license"], []),
    "unicode": (["unicode dfs 201[56]", "unicode 3 0"], ["unicode license agreement", "unicode terms of use"], []),
    "json": (["json"], ["json license"], []),
    "beerware": (["beerware"], ["beerware license", "beer ware license"], []),
    "llama-community": (["llama [23]"], ["llama [23](?: [123])? community license(?: agreement)?"], []),
    "openrail-m": (["openrail"], ["(?:bigscience |creativeml )?open ?rail m(?: license)?"], []),
    "proprietary": ([], ["all rights reserved", "proprietary and confidential", "unauthorized copying of this file"], []),
    "public-domain": ([], ["released into the public domain", "dedicated to the public domain", "placed in the public domain"], []),
}

# How a grant leads up to a license's name: (words before it, words after it, priority, confidence).
GRANTS = [
    ("spdx license identifier ", "", 0, 1.0),
    ("(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?", "", 1, 0.95),
    ("subject to (?:the )?(?:terms of the )?", "", 1, 0.9),
    ("license ", "", 2, 0.7),
    ("under (?:the )?", "", 2, 0.85),
    ("", " licen[cs]ed?", 2, 0.8),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float
    base: bool = False


_COMMON = {"the", "of", "or", "and", "in", "to", "a", "no", "by", "under", "license", "version", "software", "public", "open", "this", "for", "is", "with", "use", "free", "you", "as", "at", "any"}


def _keyword(pattern: str) -> str:
    """The longest literal word that every match of the pattern contains."""
    flat = pattern
    while True:
        shorter = re.sub(r"\((?:\?:)?[^()]*\)[?*+]?(?:\{[^}]*\})?", " \x00 ", flat)
        if shorter == flat:
            break
        flat = shorter
    plain = [w for w in flat.split(" ") if w.isalnum()]
    return max(plain, key=lambda w: (w not in _COMMON, len(w)), default="")


def build_rules() -> list[Rule]:
    """All rules in order of priority; those of the families table come from one scheme."""
    out: dict[str, Rule] = {}

    def add(label: str, pattern: str, priority: int, confidence: float) -> None:
        if pattern not in out:
            out[pattern] = Rule(label, _keyword(pattern), re.compile(f"(?<= ){pattern}(?= )"), priority, confidence)

    for label, sentences in SIGNATURES.items():
        for sentence in sentences:
            # A sentence of a text is as sure as a tag, a phrase of a few words less so.
            sure = sentence.count(" ") >= 5
            add(label, sentence, 0 if sure else 2, 0.98 if sure else 0.7)
    for label, (tags, names, short) in FAMILIES.items():
        for tag in tags:
            add(label, f"spdx license identifier {tag}", 0, 1.0)
        for name in [*names, *short]:
            for before, after, priority, confidence in GRANTS:
                add(label, before + name + after, priority, confidence)
        for name in names:
            add(label, name, 3, 0.6)
        for name in short:
            if " " in name or any(c.isdigit() for c in name):
                add(label, name, 4, 0.4)
    return sorted(out.values(), key=lambda r: r.priority)


_rules: list[tuple[str, list[Rule]]] | None = None


def _by_keyword() -> list[tuple[str, list[Rule]]]:
    global _rules
    if _rules is None:
        by: dict[str, list[Rule]] = {}
        for rule in build_rules():
            by.setdefault(rule.keyword, []).append(rule)
        _rules = sorted(by.items())
    return _rules


@dataclass(frozen=True)
class Detection:
    """A rule's match: words first up to, not including, end."""

    label: str
    first: int
    end: int
    priority: int
    confidence: float


#: Words in a cell of the index of kept detections.
CELL = 64


def suppressed(found: list[Detection]) -> list[Detection]:
    """The detections that remain: by priority, then length, then place, then label; one inside a kept one goes, as does one
    that overlaps a kept one of a stronger priority.

    Kept ones are indexed by the cells of words that they touch, so a long file of license lines costs no more per line.
    """
    kept: list[Detection] = []
    cells: dict[int, list[Detection]] = {}
    for d in sorted(found, key=lambda d: (d.priority, d.first - d.end, d.first, d.label)):
        touched = range(d.first // CELL, (d.end - 1) // CELL + 1)
        near = (k for c in touched for k in cells.get(c, ()))
        if not any(k.first <= d.first and d.end <= k.end or (k.priority < d.priority and d.first < k.end and k.first < d.end) for k in near):
            kept.append(d)
            for c in touched:
                cells.setdefault(c, []).append(d)
    return sorted(kept, key=lambda d: (d.first, d.end, d.label))


def detect(words: list[str]) -> list[Detection]:
    """Detections in one text, given its words."""
    line = f" {' '.join(words)} "
    have, found = set(words), []
    spaces = None
    for keyword, rules in _by_keyword():
        if keyword and keyword not in have:
            continue
        for rule in rules:
            for m in rule.pattern.finditer(line):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32) == 0x20)
                first = int(np.searchsorted(spaces, m.start())) - 1
                found.append(Detection(rule.label, first, first + m[0].count(" ") + 1, rule.priority, rule.confidence))
    return suppressed(found)


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(word, label) of every place where a base phrase stands."""
    out = []
    for phrase, label in BASE_PHRASES.items():
        want = phrase.split(" ")
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                out.append((at, label))
    return sorted(out)


def _gate_hashes() -> np.ndarray:
    """Hashes of the words that open the gate, in order."""
    from ._text import span_hashes

    words = sorted({k for k, _ in _by_keyword() if k} | {"mit", "apache", "cc"})
    data = "".join(words).encode()
    lengths = np.array([len(w.encode()) for w in words])
    end = np.cumsum(lengths)
    return np.sort(span_hashes(np.frombuffer(data, np.uint8), end - lengths, end))


RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections string"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs; one pass over the texts, no shuffle.

    The prefilter looks up the hash of every word among the keywords' hashes; only texts with a keyword are decoded and
    matched against the rules of the keywords they have.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = _gate_hashes()
        for batch in batches:
            for a, b, texts in steps(batch.column("text")):
                low = texts.lowered()
                words = Words(low, ALPHANUMERIC)
                hashes = words.hashes()
                at = np.minimum(np.searchsorted(gate, hashes), len(gate) - 1)
                hits = np.concatenate([[0], np.cumsum(gate[at] == hashes)])
                n = len(texts)
                open_ = np.flatnonzero(hits[words.first[1:]] > hits[words.first[:-1]])
                n_base = np.zeros(n, np.int64)
                first: list[int | None] = [None] * n
                last: list[int | None] = [None] * n
                base_labels, labels, places = [""] * n, [""] * n, [""] * n
                score = np.zeros(n)
                for i in open_.tolist():
                    w = slice(words.first[i], words.first[i + 1])
                    own = [bytes(low.data[s:e]).decode("utf-8", "replace") for s, e in zip(words.start[w].tolist(), words.end[w].tolist())]
                    base, more = base_places(own), detect(own)
                    n_base[i] = len(base)
                    if base:
                        first[i], last[i] = base[0][0], base[-1][0]
                    named = {label for _, label in base}
                    base_labels[i] = ",".join(sorted(named))
                    labels[i] = ",".join(sorted(named | {d.label for d in more}))
                    places[i] = ",".join(f"{d.label}:{d.first}:{d.end}" for d in more)
                    score[i] = max([d.confidence for d in more] + [0.9] * bool(base), default=0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score), pa.array(places)],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )
        release()

    return in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, RESULT)
