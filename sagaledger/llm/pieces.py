"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file.  The normaliser rewrites a text as the model's own settings say: its table
of replaced strings, a mark before the text, marks for spaces, runs of spaces made one.  The pieces are the arcs of a trie
whose paths spell them and give off their ids at weight 1.  The byte fallback spells any character that no piece has as the
ids of its UTF-8 bytes, at a weight of 1 for each.  They are composed with an input on the fly, and the tropical-semiring
shortest path through the composition is the encoding.

The model is a byte-pair one, whose encoding is not the best-scored segmentation but the result of merges.  That is a regular
relation all the same: a sequence of pieces is what the merges make exactly if they make each two neighbours from the two
joined, since a merge over a border depends on nothing beyond the two pieces beside it.  So a fourth automaton, whose states
are the last piece, lets a piece follow another at weight 0 or infinity; its arcs are found by merging just the two, and kept.

Nothing merges across two characters that stand beside each other in no piece.  Texts are cut there by array operations, and
equal units share one path.  Inside a long unit the path is given off as far as all live states agree on it, so the memory of
a search does not grow with the unit.

Defined results: a null or empty text has no pieces; rows that repeat a doc_id are encoded one by one; a null doc_id stays
null; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import STEP_BYTES, UnitEncoder
from ._frames import in_batches
from ._text import Texts, buffers, release, steps

MARK = "▁"  # what the normaliser writes for a space
#: No piece: the state of the neighbour automaton at a begin and after a fallback.
NONE = -1
#: Pairs of neighbours that a worker keeps, and characters between two looks at what all live states agree on.
PAIRS, LOOK = 200_000, 2048
#: Code points that the table of cuts tells apart; all others share the last class.
_NEAR = 0x240


def wire_fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message: integers, floats of 4 and 8 bytes as bytes, and bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says: pieces (text, score, type), and the normaliser's settings."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    replaced: dict[str, str] = field(default_factory=dict)
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


# Numbers of fields and of piece types in model files.
_PIECES, _NORMALISER = 1, 3
_CHARSMAP, _PREFIX, _SQUEEZE, _ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def replaced_strings(charsmap: bytes) -> dict[str, str]:
    """The table of a compiled character map: a double-array trie of sources, then the targets, each ended by a zero byte."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    unit, targets = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]

    def base(u: int) -> int:
        return (u >> 10) << ((u & (1 << 9)) >> 6)

    out: dict[str, str] = {}
    todo = [(b"", base(unit[0]))]
    while todo:
        have, node = todo.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at < len(unit) and unit[at] & (1 << 31 | 0xFF) == byte:
                below, key = at ^ base(unit[at]), have + bytes([byte])
                if unit[at] >> 8 & 1:
                    place = unit[below] & ~(1 << 31)
                    out[key.decode("utf-8", "surrogateescape")] = targets[place : targets.index(b"\0", place)].decode()
                todo.append((key, below))
    return out


def read_model(path: str) -> Spec:
    with open(path, "rb") as f:
        raw = f.read()
    out = Spec()
    for number, value in wire_fields(raw):
        if number == _PIECES:
            got = dict(wire_fields(value))
            score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            out.pieces.append((got.get(1, b"").decode(), score, got.get(3, NORMAL)))
        elif number == _NORMALISER:
            got = dict(wire_fields(value))
            out.replaced = replaced_strings(got.get(_CHARSMAP, b""))
            out.dummy_prefix, out.squeeze, out.escape = (bool(got.get(k, 1)) for k in (_PREFIX, _SQUEEZE, _ESCAPE))
    return out


class Normaliser:
    """A transducer from characters to characters.  States: before any character (0), after a space (1), after another (2).

    ``arcs[state, symbol]`` is (output, next state) for spaces; replaced strings are the paths of a trie that starts in every
    state, taken at their longest; any other character is its own output and leads to state 2.
    """

    def __init__(self, spec: Spec):
        self.space = MARK if spec.escape else " "
        self.prefix = self.space if spec.dummy_prefix else ""
        self.squeeze = spec.squeeze
        self.arcs = {(0, " "): (self.prefix + ("" if spec.squeeze else self.space), 0 if spec.squeeze else 1), (1, " "): ("" if spec.squeeze else self.space, 1), (2, " "): (self.space, 1)}
        if spec.squeeze:
            self.arcs[0, " "] = ("", 0)
        self.trie: dict[str, dict] = {}
        for source, target in spec.replaced.items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        #: Whether spaces to marks and a mark in front are all it does, which array operations on whole columns can do.
        self.plain = not self.trie and not self.squeeze and spec.escape and spec.dummy_prefix

    def _replaced(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            node, end, best, to = self.trie, at, None, at
            while end < len(text) and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    best, to = node[""], end
            yield text[at] if best is None else best
            at = at + 1 if best is None else to

    def apply(self, text: str) -> str:
        out, state = [], 0
        for part in self._replaced(text):
            for c in part:
                if c == " ":
                    more, state = self.arcs[state, c]
                else:
                    more, state = (self.prefix if state == 0 else "") + c, 2
                out.append(more)
        done = "".join(out)
        return done.rstrip(self.space) if self.squeeze else done


class Transducer:
    """Normaliser, pieces, byte fallback and neighbours of one model."""

    def __init__(self, path: str):
        spec = read_model(path)
        self.size = len(spec.pieces)
        self.normaliser = Normaliser(spec)
        self.bytes_ = [0] * 256
        self.text_of: list[bytes] = [b""] * self.size
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        #: Arcs of the trie: (state << 21 | code point) leads to a state; the piece that ends in a state, or NONE.
        self.arcs: dict[int, int] = {}
        self.ends = [NONE]
        self.pairs: set[str] = set()
        for i, (piece, score, kind) in enumerate(spec.pieces):
            if kind == BYTE:
                value = int(piece[1:-1], 16)
                self.bytes_[value] = i
                self.text_of[i] = bytes([value])
            elif kind in (NORMAL, USER):
                self.text_of[i] = piece.encode()
                self.score[piece], self.id_of[piece] = score, i
                self.pairs.update(map("".join, zip(piece, piece[1:])))
                state = 0
                for c in piece:
                    key = state << 21 | ord(c)
                    if key not in self.arcs:
                        self.arcs[key] = len(self.ends)
                        self.ends.append(NONE)
                    state = self.arcs[key]
                self.ends[state] = i
        self.spelled = [t.decode("utf-8", "replace") for t in self.text_of]
        self.beside: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a text: of all neighbours that join to a piece, the best-scored and leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            joined = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            if all(s is None for s in joined):
                break
            at = max((i for i, s in enumerate(joined) if s is not None), key=lambda i: (joined[i], -i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        """The arc of the neighbour automaton: whether it has weight 0."""
        key = left * self.size + right
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            a, b = self.spelled[left], self.spelled[right]
            known = self.beside[key] = self.merged(a + b) == [a, b]
        return known

    def path(self, text: str) -> list[int]:
        """Ids of the shortest path through pieces, fallback and neighbours composed with a normalised text."""
        n, arcs, ends = len(text), self.arcs, self.ends
        points = list(map(ord, text))
        out: list[int] = []
        # live[place]: for each last piece its cost and its chain (ids given off by its last arc, chain before it)
        live: dict[int, dict[int, tuple[int, tuple | None]]] = {0: {NONE: (0, None)}}
        for i in range(n):
            here = live.pop(i, None)
            if not here:
                continue
            if i and i % LOOK == 0:
                out += self._agreed(live, here)
            state, j = arcs.get(points[i]), i + 1
            if state is None:
                # The fallback's path has nothing to merge with, so any piece may stand beside it.
                raw = text[i].encode()
                cost, chain = min(here.values(), key=lambda s: s[0])
                live.setdefault(j, {})[NONE] = (cost + len(raw), (tuple(self.bytes_[b] for b in raw), chain))
                continue
            while state is not None:
                piece = ends[state]
                if piece != NONE:
                    there = None
                    for last, (cost, chain) in here.items():
                        if (there is None or cost + 1 < there[0]) and (last == NONE or self.may_follow(last, piece)):
                            there = (cost + 1, ((piece,), chain))
                    if there is not None:
                        live.setdefault(j, {})[piece] = there
                if j == n:
                    break
                state = arcs.get(state << 21 | points[j])
                j += 1
        if n and not live.get(n):
            raise ValueError("no path: the model's pieces do not cover their own characters")
        best = min(live[n].values(), key=lambda s: s[0])[1] if n else None
        return out + self._spell(best)

    @staticmethod
    def _spell(chain: tuple | None) -> list[int]:
        parts = []
        while chain is not None:
            ids, chain = chain
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def _agreed(self, live: dict, here: dict) -> list[int]:
        """What all live chains share from the begin; it is taken out of them."""
        states = [here, *live.values()]
        chains = []
        for at in states:
            for _, chain in at.values():
                links = []
                while chain is not None:
                    links.append(chain)
                    chain = chain[1]
                chains.append(links[::-1])
        same = 0
        while all(len(c) > same for c in chains) and all(c[same][0] == chains[0][same][0] for c in chains):
            same += 1
        if not same:
            return []
        out = [i for link in chains[0][:same] for i in link[0]]
        k = 0
        for at in states:
            for last, (cost, _) in list(at.items()):
                chain = None
                for link in chains[k][same:]:
                    chain = (link[0], chain)
                at[last] = (cost, chain)
                k += 1
        return out

    def encode(self, text: str) -> list[int]:
        return self.pieces(self.normaliser.apply(text))

    def pieces(self, text: str) -> list[int]:
        """Ids of a normalised text, from the paths of its units."""
        out, at = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in self.pairs:
                out += self.path(text[at:i])
                at = i
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; marks become spaces, and the one that stands before every text goes."""
        text = b"".join([self.text_of[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text


class PieceEncoder(UnitEncoder):
    """Arrow columns by a transducer, with the bounded cache of units.  In units a space stands for its mark."""

    def __init__(self, path: str):
        made = self.transducer = Transducer(path)
        self.dtype = np.dtype("<u2" if made.size <= 1 << 16 else "<u4")
        near = lambda c: ord(" ") if c == MARK else min(ord(c), _NEAR)
        joined = np.zeros((_NEAR + 1, _NEAR + 1), dtype=bool)
        for a, b in made.pairs:
            joined[near(a), near(b)] = True
        # The last class holds the mark too, which a text may have.
        joined[_NEAR] |= joined[ord(" ")]
        joined[:, _NEAR] |= joined[:, ord(" ")]
        joined[_NEAR, _NEAR] |= joined[ord(" "), ord(" ")]
        self.joined = joined
        self._clear()

    def prepared(self, column: pa.Array) -> Texts:
        if not self.transducer.normaliser.plain:
            done = [self.transducer.normaliser.apply(t or "").replace(MARK, " ") for t in column.to_pylist()]
            return Texts(*buffers(pa.array(done, pa.large_string())))
        data, offsets = buffers(column)
        size = np.diff(offsets)
        more = (size > 0).astype(np.int64)
        after = np.concatenate([[0], np.cumsum(size + more)])
        out = np.full(int(after[-1]), ord(" "), dtype=np.uint8)
        inner = np.ones(len(out), dtype=bool)
        inner[after[:-1][more > 0]] = False
        out[inner] = data
        return Texts(out, after)

    def cut(self, texts: Texts) -> np.ndarray:
        data = texts.data
        if not len(data):
            return np.zeros(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead].astype(np.int64)
        point = np.where(first < 0x80, first, _NEAR)
        two = np.flatnonzero((first >= 0xC2) & (first < 0xC9))
        point[two] = (first[two] & 0x1F) << 6 | data[lead[two] + 1] & 0x3F
        begin = np.ones(len(lead), dtype=bool)
        begin[1:] = ~self.joined[point[:-1], point[1:]]
        heads = texts.offsets[:-1][texts.offsets[:-1] < texts.offsets[1:]]
        begin[np.searchsorted(lead, heads)] = True
        return lead[begin]

    def units(self, raw: list[bytes]) -> list[list[int]]:
        return [self.transducer.pieces(u.decode().replace(" ", MARK)) for u in raw]

    def whole(self, text: str) -> list[int]:
        return self.transducer.encode(text)


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


RESULT = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean"


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: number and checksum of its ids, and whether decoding them gives the text back (marks
    in it as spaces); the ids too if asked for.  One pass over the texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = piece_encoder(model)
        names = np.array(made.transducer.text_of, dtype=object)
        prefix = len(made.transducer.normaliser.prefix)
        for batch in batches:
            for a, b, _ in steps(batch.column("text"), STEP_BYTES):
                column = batch.column("text").slice(a, b - a)
                ids, at = made.encode(column)
                wide = ids.astype("<u4")
                raw = memoryview(wide).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                back = []
                for i, text in enumerate(column.to_pylist()):
                    got = b"".join(names[ids[at[i] : at[i + 1]]].tolist()).decode("utf-8", "replace").replace(MARK, " ")
                    back.append(got[prefix:] == (text or "").replace(MARK, " "))
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(back)]
                fields = [c.split()[0] for c in RESULT.split(", ")]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(wide.astype(np.int32))))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=fields)
        release()

    rows = in_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT + (", ids array<int>" if with_ids else ""))


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = piece_encoder(model).transducer
        for batch in batches:
            texts = [None if ids is None else made.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
