"""Secret scans: fixed base patterns, and a linear-chain conditional random field over the words of a text.

The base patterns (assignments, access ids, long hexadecimal runs) are matched exactly and always reported.  The field
tags each word as begin, inside or outside of a secret, from the shape of the word, the words beside it and features of
the whole text; Viterbi decodes the tags.  What it finds outside of the base
spans is added with kind ``other``; of a span that they cover in part, the parts outside of them are added.

No table labels secrets, so the field learns from a bounded sample of texts: words inside base matches are secrets, all
others are not, and made-up secrets of other forms and made-up things that only look alike (addresses, dates, numbers,
links) are put into copies of the sample with their labels.

Decoding is exact without visiting every word: where no run of words through a word can gain anything over outside, the best
path has outside there, so the chain falls apart at that word.  Viterbi runs over the few stretches that remain.

Defined results: a null text counts as an empty one and has no spans; repeated rows are scanned one by one; a null doc_id
stays null; an empty table gives an empty result; columns other than doc_id and text are not read (``redact`` carries
them along).  Without a sample only the made-up examples teach the field.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chain import marginals, viterbi
from ._frames import in_batches, labelled_sample
from ._text import LEADING, NOT_SPACE, Texts, Words, buffers, count_in, release, span_hashes, steps

# The base patterns, and how long a match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "other")

#: Labelled rows of each quality class whose texts teach the field, at most.
SAMPLE_PER_CLASS = 400
#: Words in a training stretch, and stretches at most.
STRETCH, STRETCHES = 32, 3000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

OUT, BEGIN, INSIDE = 0, 1, 2

# Words that announce a secret.
CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "key", "credential", "credentials", "bearer", "auth", "authorization", "private", "access", "login", "pin")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_MIN]
    return sorted(out)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
_HEX = _table(b"0123456789abcdef")
_JOIN = _table(b"+/_=-")
_SIGN = _table(b":=")
_DASH = _table(b"-")
_KIND = np.zeros(256, dtype=np.int8)  # for switches between character kinds
_KIND[_UPPER], _KIND[_LOWER], _KIND[_DIGIT] = 1, 2, 3

_cue_hashes: np.ndarray | None = None


def _cues() -> np.ndarray:
    global _cue_hashes
    if _cue_hashes is None:
        forms = sorted({c + end for c in CUES for end in ("", ":", "=", "is", ",", ".")})
        data = np.frombuffer("".join(forms).encode(), np.uint8)
        end = np.cumsum([len(f) for f in forms])
        _cue_hashes = np.sort(span_hashes(data, end - np.array([len(f) for f in forms]), end))
    return _cue_hashes


#: Features of a word: its shape, the cue and shape of the words beside it, and the text's.
SHAPE = 14
WIDTH = 1 + SHAPE + 5 + 2


def word_features(texts: Texts, words: Words) -> np.ndarray:
    """One row per word."""
    data, start, end = texts.data, words.start, words.end
    size = (end - start).astype(np.float32)

    def share(table: np.ndarray) -> np.ndarray:
        run = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(table[data], out=run[1:], dtype=np.int32)
        return (run[end] - run[start]).astype(np.float32)

    upper, lower, digit, joined, sign, hexes, dash = map(share, (_UPPER, _LOWER, _DIGIT, _JOIN, _SIGN, _HEX, _DASH))
    kind = _KIND[data]
    run = np.zeros(len(data) + 1, dtype=np.int32)
    if len(data):
        np.cumsum((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0), out=run[2:], dtype=np.int32)
    switches = (run[end] - run[np.minimum(start + 1, len(data))]).astype(np.float32)
    many = np.maximum(size, 1)
    low = texts.lowered()
    hashes = span_hashes(low.data, start, end)
    cues = _cues()
    cue = (cues[np.minimum(np.searchsorted(cues, hashes), len(cues) - 1)] == hashes).astype(np.float32)
    other = size - upper - lower - digit - joined - sign
    shape = np.empty((len(start), SHAPE), dtype=np.float32)
    shape[:, 0] = size >= 8
    shape[:, 1] = size >= 14
    shape[:, 2] = size >= 20
    shape[:, 3] = np.minimum(digit, 8) / 8
    shape[:, 4] = np.minimum(switches, 8) / 8
    shape[:, 5] = (digit > 0) & (upper + lower > 0)
    shape[:, 6] = np.minimum(joined, 4) / 4
    shape[:, 7] = np.minimum(sign, 2) / 2
    shape[:, 8] = np.minimum(other, 4) / 4
    shape[:, 9] = np.minimum(np.maximum(upper - 1, 0), 6) / 6
    shape[:, 10] = (digit + joined + other + sign >= size) & (size > 0)
    shape[:, 11] = switches / many
    shape[:, 12] = (hexes + dash >= size) & (dash > 0)
    shape[:, 13] = digit / many
    odd = shape[:, 4] * 8 >= 2
    x = np.zeros((len(start), WIDTH), dtype=np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + SHAPE] = shape
    at = 1 + SHAPE
    inner = np.ones(len(start), dtype=bool)
    first = words.first[:-1]
    inner[first[first < len(inner)]] = False
    to = np.flatnonzero(inner)
    x[to, at] = cue[to - 1]
    x[to, at + 1] = sign[to - 1] > 0
    x[to, at + 2] = odd[to - 1]
    x[to - 1, at + 3] = odd[to]
    x[:, at + 4] = cue
    counts = np.maximum(words.counts, 1)
    x[:, at + 5] = np.repeat(np.minimum(count_in(texts, _SIGN) / counts, 1), words.counts)
    x[:, at + 6] = np.repeat(np.minimum(count_in(texts, _DIGIT) / counts / 4, 1), words.counts)
    return x


@dataclass
class Tagger:
    weights: np.ndarray
    move: np.ndarray

    def _undecided(self, up: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places that may have another label than outside on the best path.

        A run of such places on the best path gains something over outside in all of them.  What a run can gain is at most
        the sum of its places' best margins over outside, the dearest ways in and out, and the dearest step inside for each
        place but one.  A place is left to Viterbi if some run through it could gain; the best run through each place comes
        from two running sums.
        """
        move, at_rest = self.move, self.move[OUT, OUT]
        step = move[BEGIN:, BEGIN:].max() - at_rest
        ends = move[OUT, BEGIN:].max() + move[BEGIN:, OUT].max() - 2 * at_rest - step
        gain = (up[:, BEGIN:].max(1) - up[:, OUT]).astype(float) + step

        def best_so_far(gain: np.ndarray, begins: np.ndarray) -> np.ndarray:
            """The best sum of a run that ends at each place and does not cross the begin of a text."""
            total = np.cumsum(gain)
            before = total - gain
            # Texts are set apart so far that the least sum before a place is one of its own text's.
            apart = np.cumsum(begins) * (1.0 + np.abs(gain).sum())
            return total - (np.minimum.accumulate(before - apart) + apart)

        heads = np.zeros(len(up), dtype=bool)
        tails = np.zeros(len(up), dtype=bool)
        filled = np.diff(first) > 0
        heads[first[:-1][filled]] = tails[first[1:][filled] - 1] = True
        through = best_so_far(gain, heads) + best_so_far(gain[::-1], tails[::-1])[::-1] - gain
        return np.flatnonzero(through + ends >= -1e-3)

    def tagged(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of every word; Viterbi over the stretches that can hold another label than outside."""
        up = x @ self.weights
        out = np.zeros(len(up), dtype=np.int8)
        at = self._undecided(up, first)
        if not len(at):
            return out
        begins = np.zeros(len(up) + 1, dtype=bool)
        begins[first] = True
        cut = np.flatnonzero((np.diff(at) > 1) | begins[at[1:]])
        for s, e in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut + 1, [len(at)]])):
            a, b = int(at[s]), int(at[e - 1]) + 1
            # Beside the stretch stands outside; a text's edges count as outside too.
            out[a:b] = viterbi(up[a:b], self.move, self.move[OUT], self.move[:, OUT])
        return out


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def _made_up(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Words with labels: a made-up secret, or a made-up thing that only looks alike."""

    def draw(chars: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(chars), int(rng.integers(low, high + 1))))

    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = letters + letters.upper() + digits
    kinds = [
        lambda: (["ghp_" + draw(every, 30, 40)], [1]),
        lambda: (["sk_live_" + draw(every, 20, 32)], [1]),
        lambda: (["xoxb-" + draw(digits, 10, 12) + "-" + draw(every, 20, 28)], [1]),
        lambda: (["Bearer", draw(every, 18, 30) + "." + draw(every + "_-", 20, 60)], [0, 1]),
        lambda: (["password", "is", draw(every, 5, 10) + draw(digits, 2, 4) + draw(every, 2, 4)], [0, 0, 1]),
        lambda: (["secret", "key", draw(every + "+/", 30, 44)], [0, 0, 1]),
        lambda: (["private", "key", draw(every + "+/", 40, 64), draw(every + "+/", 40, 64), draw(every + "+/", 20, 44) + "="], [0, 0, 1, 2, 2]),
        lambda: ([f"postgres://{draw(letters, 4, 8)}:{draw(every, 8, 14)}@{draw(letters, 5, 9)}:5432/{draw(letters, 3, 8)}"], [1]),
        lambda: ([".".join(str(int(v)) for v in rng.integers(0, 256, 4))], [0]),
        lambda: ([f"{draw(letters, 3, 10)}{draw(digits, 0, 3)}@{draw(letters, 4, 9)}.com"], [0]),
        lambda: ([f"{draw(letters, 3, 8)}.{draw(letters, 3, 8)}@{draw(letters, 4, 9)}.org"], [0]),
        lambda: (["+" + draw(digits, 2, 2) + "-" + draw(digits, 3, 3) + "-" + draw(digits, 3, 3) + "-" + draw(digits, 4, 4)], [0]),
        lambda: (["(" + draw(digits, 3, 3) + ")", draw(digits, 3, 3) + "-" + draw(digits, 4, 4)], [0, 0]),
        lambda: ([draw(digits, 4, 4), draw(digits, 4, 4), draw(digits, 4, 4), draw(digits, 4, 4)], [0, 0, 0, 0]),
        lambda: ([draw(digits, 9, 16)], [0]),
        lambda: ([draw(digits, 2, 4) + "-" + draw(digits, 2, 2) + "-" + draw(digits, 2, 4)], [0]),
        lambda: ([f"https://{draw(letters, 4, 10)}.com/{draw(letters, 4, 9)}/{draw(letters, 3, 12)}?id={draw(digits, 1, 6)}"], [0]),
        lambda: ([f"{draw(letters, 4, 9)}_{draw(letters, 4, 9)}_{draw(digits, 1, 3)}.txt"], [0]),
        lambda: ([f"{draw(letters, 4, 12)}-{draw(letters, 4, 12)}"], [0]),
        lambda: ([draw(letters, 16, 34)], [0]),
        lambda: (["password", draw(letters, 4, 9)], [0, 0]),
        lambda: (["the", "token", "of", "key"], [0, 0, 0, 0]),
        lambda: ([draw(letters, 3, 9) + ":"], [0]),
        lambda: ([f"{draw(letters, 2, 6)}={draw(digits, 1, 3)}"], [0]),
        lambda: (["v" + ".".join(str(int(v)) for v in rng.integers(0, 30, 3))], [0]),
        lambda: ([draw(letters.upper(), 6, 14)], [0]),
        lambda: (["-".join(draw("0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12))], [0]),
        lambda: ([f"{draw(digits, 4, 4)}-{draw(digits, 2, 2)}-{draw(digits, 2, 2)}T{draw(digits, 2, 2)}:{draw(digits, 2, 2)}:{draw(digits, 2, 2)}Z"], [0]),
        lambda: ([f"{draw(letters, 4, 9)}-{draw(digits, 1, 2)}.{draw(digits, 1, 2)}.{draw(digits, 1, 2)}-{draw(letters, 1, 4)}{draw(digits, 2, 3)}"], [0]),
        lambda: ([f"/{draw(letters, 3, 5)}/{draw(letters, 4, 8)}{draw(digits, 1, 2)}/{draw(letters, 4, 9)}-{draw(digits, 1, 4)}.{draw(letters, 2, 3)}"], [0]),
        lambda: ([f"{draw(letters.upper(), 2, 4)}_{draw(digits, 8, 8)}_{draw(digits, 6, 6)}.{draw(letters, 3, 3)}"], [0]),
        lambda: (["pwd", draw(every, 4, 7) + rng.choice(list("!?$@+")) + draw(every, 4, 7)], [0, 1]),
    ]
    return kinds[int(rng.integers(0, len(kinds)))]()


def _examples(texts: list[str], rng: np.random.Generator) -> tuple[list[str], list[np.ndarray]]:
    """Stretches of words, each one text, with the labels of their words."""
    out, labels = [], []
    for text in texts:
        spans = _word_spans(text)
        if not spans:
            continue
        marks = np.zeros(len(spans), dtype=np.int8)
        starts = np.array([s for s, _ in spans])
        for s, _, e in base_spans(text):
            a, b = int(np.searchsorted(starts, s, side="right")) - 1, int(np.searchsorted(starts, e))
            marks[a:b] = INSIDE
            marks[a] = BEGIN
        hot = np.flatnonzero(marks == BEGIN)
        places = [max(0, int(p) - int(rng.integers(0, STRETCH))) for p in hot[:4]] + [int(rng.integers(0, len(spans)))]
        for p in places:
            part = spans[p : p + STRETCH]
            out.append([text[s:e] for s, e in part])
            labels.append(marks[p : p + len(part)])
    order = rng.permutation(len(out))[:STRETCHES]
    made, made_labels = [], []
    for i in [*order, *[-1] * max(0, 400 - len(order))]:
        words, marks = (out[i], labels[i]) if i >= 0 else (["a", "line", "of", "words"], np.zeros(4, np.int8))
        more, tags = _made_up(rng)
        at = int(rng.integers(0, len(words) + 1))
        # The stretch stays whole on both sides of what is put in.
        if at < len(words) and marks[at] == INSIDE:
            at = 0
        made.append(" ".join([*words[:at], *more, *words[at:]]))
        made_labels.append(np.concatenate([marks[:at], np.array(tags, np.int8), marks[at:]]))
    plain = [" ".join(out[i]) for i in order]
    return plain + made, [labels[i] for i in order] + made_labels


def train(texts: list[str], seed: int = 3) -> Tagger:
    rng = np.random.default_rng(seed)
    stretches, labels = _examples(texts, rng)
    column = pa.array(stretches)
    data, offsets = buffers(column)
    whole = Texts(data, offsets)
    words = Words(whole, NOT_SPACE)
    x = word_features(whole, words).astype(float)
    y = np.concatenate(labels).astype(int)
    first = words.first
    head = np.zeros(len(y), dtype=bool)
    head[first[:-1]] = True
    to = np.flatnonzero(~head)
    truth = np.eye(3)[y]
    seen = np.zeros((3, 3))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    theta = np.zeros(WIDTH * 3 + 9)
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    rare = np.where(y == OUT, 1.0, np.minimum(10.0, 0.2 * len(y) / max(1, (y != OUT).sum())))
    for step in range(1, STEPS + 1):
        w, move = theta[: WIDTH * 3].reshape(WIDTH, 3), theta[WIDTH * 3 :].reshape(3, 3)
        p, joint = marginals(x @ w, first, move)
        grad = np.concatenate([(x.T @ (rare[:, None] * (truth - p))).ravel(), (seen - joint).ravel()]) / len(y) - RIDGE * 0.01 * theta
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad**2
        theta = theta + RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    w, move = theta[: WIDTH * 3].reshape(WIDTH, 3), np.clip(theta[WIDTH * 3 :].reshape(3, 3), -4, 4)
    move[OUT, INSIDE] = min(move[OUT, INSIDE], -4)  # inside needs a begin before it
    return Tagger(w.astype(np.float32), move)


def train_on(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Tagger:
    """A tagger from the texts of a bounded sample of labelled rows; their labels are not used."""
    got = labelled_sample(docs, labels, "quality", F.lit(True), per_class).toArrow().sort_by("doc_id")
    tagger = train(got["text"].to_pylist())
    del got
    release()
    return tagger


_STRIP = "\"'`(),;.[]{}<>"


def _gated(texts: Texts) -> np.ndarray:
    """True for texts that a base pattern can match: a colon or equals sign, AKIA, or a long hexadecimal run."""
    gate = count_in(texts, _SIGN) > 0
    data = texts.data
    hexes = np.zeros(len(data) + 2, dtype=np.int8)
    hexes[1:-1] = _HEX[data]
    edge = np.diff(hexes)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = begin[end - begin >= HEX_MIN]
    raw = data.tobytes()
    at, found = raw.find(b"AKIA"), []
    while at >= 0:
        found.append(at)
        at = raw.find(b"AKIA", at + 4)
    for places in (long, np.array(found, dtype=np.int64)):
        if len(places):
            # a run that crosses a text's edge is checked by the exact pattern
            gate[np.searchsorted(texts.offsets, places, side="right") - 1] = True
    crossing = np.flatnonzero(end - begin >= HEX_MIN)
    for k in crossing.tolist():
        a, b = np.searchsorted(texts.offsets, [begin[k], end[k] - 1], side="right") - 1
        gate[a : b + 1] = True
    return gate


#: Letters and digits of what a found span has outside of base spans, at least: less is a closing quote, or marks behind a word.
PART_MIN = 4


def _outside(raw: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a found span outside of the base ones, which are sorted by start; no white space at their edges, and none
    of fewer than PART_MIN letters and digits."""
    parts, at = [], 0
    for a, b in [*base, (len(raw), len(raw))]:
        part = raw[at : max(a, at)]
        if sum(map(str.isalnum, part)) >= PART_MIN:
            parts.append((at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
        at = max(at, b)
    return parts


def scan(texts: Texts, tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end), base ones and added ones, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    data, offsets = texts.data, texts.offsets
    for i in np.flatnonzero(_gated(texts)).tolist():
        out[i] = base_spans(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    words = Words(texts, NOT_SPACE)
    tags = tagger.tagged(word_features(texts, words), words.first)
    at = np.flatnonzero(tags != OUT)
    if len(at):
        owner = np.searchsorted(words.first, at, side="right") - 1
        k = 0
        while k < len(at):
            j = k + 1
            while j < len(at) and at[j] == at[j - 1] + 1 and tags[at[j]] == INSIDE and owner[j] == owner[k]:
                j += 1
            i = int(owner[k])
            s, e = int(words.start[at[k]]), int(words.end[at[j - 1]])
            raw = data[s:e].tobytes().decode("utf-8", "replace")
            s += len(raw) - len(raw.lstrip(_STRIP))
            raw = raw.strip(_STRIP)
            begin = int(np.count_nonzero(LEADING[data[offsets[i] : s]]))
            out[i] += [(begin + a, 3, begin + b) for a, b in _outside(raw, [(a - begin, b - begin) for a, kind, b in out[i] if kind < 3])]
            k = j
    for spans in out:
        spans.sort()
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row for each row of docs; one pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in steps(batch.column("text")):
                every = scan(texts, tagger)
                counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in every], pa.int64()) for kind in range(3)]
                base = pa.array([hashlib.sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in every])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *counts, base, pa.array([_joined(spans) for spans in every])], names=[c.split()[0] for c in RESULT.split(", ")])
        release()

    return in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def redact(docs: DataFrame, tagger: Tagger, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by a mark and n_chars, where there is such a column, counted anew; no row goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, place = batch.column("text"), batch.schema.get_field_index("text")
            new = column.to_pylist()
            for a, _, texts in steps(column.cast(pa.string())):
                for i, spans in enumerate(scan(texts, tagger)):
                    if not spans:
                        continue
                    text, out, at = new[a + i], [], 0
                    for s, _, e in spans:
                        if e > at:
                            out += [text[at:s], mark] if s > at or not out else []
                            at = e
                    new[a + i] = "".join(out) + text[at:]
            columns = list(batch.columns)
            columns[place] = pa.array(new, column.type)
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                changed = pa.array([None if n is None else len(n) for n in new], pa.int64()).cast(columns[at].type)
                columns[at] = changed
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        release()

    return in_batches(docs).mapInArrow(run, docs.schema)
