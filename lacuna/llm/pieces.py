"""SentencePiece encoding and decoding by streaming Viterbi.

The text runs through a lattice of pieces. Only a window as long as the longest piece is
live at any time: as soon as every live position's best path passes one boundary, the ids
up to it are final and are given out, so memory does not grow with the text.

For unigram models a path's worth is the sum of its pieces' scores. A BPE model's scores
are merge ranks and must not be summed; its paths are those whose every two neighbours are
pieces that merging would leave side by side. Each prefix has exactly one such path, and
it is the one that merging finds, so the same search gives that library's ids.

Boundaries that no piece can cross (before a run of spaces, around characters that no
longer piece holds) are points where all paths meet by construction: what lies between two of them is a
stream of its own, whose ids may be kept in a cache. Elsewhere the paths are followed back each time the
window has grown by the longest piece, and what lies before their common boundary is committed. The positions that
can still be extended are never more than the longest piece's length; those before them are kept only as long as paths disagree there.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import arrow_map, chunks, spread

SPACE = "▁"
# The model file's enumerations.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Units of up to so many characters are kept in a worker's cache, so many of them (about 150 bytes each).
CACHE = 500_000
LONGEST_CACHED = 64


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message's fields; values are ints or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Model:
    """A model file's pieces and the settings that matter here."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                m.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if m.squeeze or not m.escape or m.kind not in (UNIGRAM, BPE) or USER_DEFINED in m.kinds:
            raise ValueError("this kind of model is not supported")
        return m


class Codec:
    """Encodes and decodes with one model."""

    def __init__(self, raw: bytes):
        m = self.model = Model.parse(raw)
        self.ids = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(m.pieces, m.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(m.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min((s for s, k in zip(m.scores, m.kinds) if k == NORMAL), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.dtype = "<u2" if len(m.pieces) <= 65536 else "<u4"
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        # Boundaries that no piece crosses: around characters that no piece holds and around those that only
        # stand alone, and before a run of spaces if no piece has a space behind another character.
        spaced = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        joined = "".join(sorted({c for p in self.ids if len(p) > 1 for c in p if c != SPACE}))
        self.units = None if spaced else re.compile((f"{SPACE}*[{re.escape(joined)}]+|" if joined else "") + f"{SPACE}+|[^{SPACE}]", re.DOTALL)
        self.cache: dict[str, bytes] = {}
        self.widest = 0  # characters that the window has held at most
        self.plain = [self._plain(i) for i in range(len(m.pieces))]

    def _plain(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def merged(self, text: str, trace: list | None = None) -> list[str]:
        """What merging makes of a short string: the best-scored neighbours first, then the leftmost; ``trace`` gets each merge."""
        parts: list = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            whole = parts[i] + parts[j]
            if whole in self.ids:
                heapq.heappush(heap, (-self.model.scores[self.ids[whole]], i, j, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
                continue
            if trace is not None:
                trace.append((parts[i], parts[j]))
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes the piece; None for one character or a piece that merging never makes."""
        found = self.splits.get(piece, 0)
        if found == 0:
            trace: list[tuple[str, str]] = []
            whole = self.merged(piece, trace)
            found = self.splits[piece] = trace[-1] if whole == [piece] and trace else None
        return found

    def side_by_side(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces as they are when one follows the other.

        Undoes their merges from the last to the first. What then touches the boundary
        must not merge across it before the merge just undone: on equal ranks the
        leftmost comes first, so one further left may tie and one further right may not.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 600_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self._side_by_side(left, right)
        return found

    def _side_by_side(self, left: str, right: str) -> bool:
        ids, scores = self.ids, self.model.scores
        for piece in (left, right):
            if len(piece) > 1 and self.last_merge(piece) is None:
                return False
        if not left:
            return True
        best_allowed, tie = float("-inf"), True
        while True:
            across = ids.get(left + right)
            if across is not None and (scores[across] > best_allowed or scores[across] == best_allowed and not tie):
                return False
            parts = self.last_merge(left) if len(left) > 1 else None, self.last_merge(right) if len(right) > 1 else None
            if parts[0] is None and parts[1] is None:
                return True
            if parts[1] is None or parts[0] is not None and scores[ids[left]] < scores[ids[right]]:
                best_allowed, tie, left = scores[ids[left]], True, parts[0][1]
            else:
                best_allowed, tie, right = scores[ids[right]], False, parts[1][0]

    def stream(self, text: str):
        """Pieces of a text, each given out once all live paths agree on it.

        ``back`` holds, for each position since the last final boundary, the piece that ends there on
        its best path; only the last ``longest`` of them can still be extended. Matches come by their last character.
        """
        if len(text) == 1:
            yield text
            return
        bpe, scores, ids, pairs, longest = self.model.kind == BPE, self.model.scores, self.ids, self.pairs, self.longest
        back: list[str | None] = [""]
        worth = [0.0]
        base = checked = 0
        for last, piece in chain(self.matches.iter(text), ((len(text) - 1, None),)):
            while len(back) <= last + 1 - base:
                n = len(back) - 1
                if back[n] is None:
                    self._close(text[base + n - 1], back, worth)
                if n - checked >= longest:
                    checked = n
                    if common := self._meet(back, n):
                        done = self._path(back, common)
                        yield from done
                        back, worth = [done[-1] if bpe else "", *back[common + 1 :]], worth[common:]
                        base, checked = base + common, n - common
                    self.widest = max(self.widest, n)
                back.append(None)
                worth.append(0.0)
            if piece is None:
                break
            end = last + 1 - base
            start = end - len(piece)
            if start < 0 or (left := back[start]) is None:
                continue
            if not bpe:
                total = worth[start] + scores[ids[piece]]
                if back[end] is None or total > worth[end]:
                    back[end], worth[end] = piece, total
            elif back[end] is None:
                fits = pairs.get((left, piece))
                if fits or fits is None and self.side_by_side(left, piece):
                    back[end] = piece
        if back[-1] is None:
            self._close(text[-1], back, worth)
        yield from self._path(back, len(back) - 1)

    def _close(self, character: str, back: list, worth: list) -> None:
        """The last position, where no piece ends, is reached by its character alone if that is unknown."""
        if back[-2] is not None and (self.model.kind != BPE or character not in self.ids):
            back[-1], worth[-1] = character, worth[-2] + self.worst

    def _path(self, back: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(back[end])
            end -= len(back[end])
        return out[::-1]

    def _meet(self, back: list, n: int) -> int:
        """The last boundary on the best path of every position that a piece to come could start from."""
        ends = {i for i in range(max(0, n - self.longest + 1), n + 1) if back[i] is not None}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - len(back[last]))
            if max(ends) <= 0:
                return 0
        return ends.pop() if ends else 0

    def _to_ids(self, pieces) -> bytes:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, self.dtype).tobytes()

    def unit_ids(self, unit: str) -> bytes:
        found = self.cache.get(unit)
        if found is None:
            found = self._to_ids(self.stream(unit))
            if len(unit) <= LONGEST_CACHED:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[unit] = found
        return found

    def encode(self, text: str) -> bytes:
        """All ids, without begin and end, in the codec's dtype; characters that no piece holds are one unknown id a run."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        if self.units is None:
            raw = self._to_ids(self.stream(text))
        else:
            raw = b"".join(map(self.unit_ids, self.units.findall(text)))
        if self.bytes:
            return raw
        ids = np.frombuffer(raw, self.dtype)
        again = np.r_[False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)] if len(ids) else ids
        return ids[~again].tobytes() if len(ids) else raw

    def decode(self, ids: bytes) -> str:
        """The text of ids; the first space is the dummy prefix and goes."""
        raw = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, self.dtype).tolist()))
        if self.model.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode(errors="replace")


@lru_cache(maxsize=2)
def load(raw: bytes) -> Codec:
    return Codec(raw)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_ids and ids (unsigned little-endian, 16 bits for up to 65,536 pieces, else 32) of each row.

    A null text counts as empty; an empty text has no ids. Rows stay as they are, repeated
    and null ids included; other columns are not read.
    """
    raw = Path(model).read_bytes()
    width = 2 if len(Model.parse(raw).pieces) <= 65536 else 4
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        codec = load(shared.value)
        for batch in chunks(batches, "text"):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [codec.encode(x) for x in texts]
            yield {"doc_id": batch.column(0), "n_bytes": [len(x.encode()) for x in texts], "n_ids": [len(x) // width for x in ids], "ids": ids}

    return arrow_map(spread(rows), run, ENCODED)


def decode_pieces(encoded: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns ``keep`` of rows with ids as ``encode_pieces`` gives them; null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    rows = encoded.select("doc_id", "ids", *keep)
    schema = T.StructType([*DECODED.fields, *(encoded.schema[k] for k in keep)])

    def run(batches):
        codec = load(shared.value)
        for batch in chunks(batches, "ids"):
            texts = [codec.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "text": texts} | {k: batch.column(2 + i) for i, k in enumerate(keep)}

    return arrow_map(rows, run, schema)
