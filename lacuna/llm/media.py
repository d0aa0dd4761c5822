"""Media columns: signature sniffing, validation, type correction and carving.

Aho-Corasick finds every magic string of all formats in one pass over a value. A hit
only counts when the format's own structure holds from there on (chunk lengths,
checksums, markers, sizes), which also gives the exact length; so texts that happen to
hold magic bytes are not taken for media. Chains of structures are walked once, whatever
number of hits leads into them. The outermost valid hit at the start names
the value's type, which replaces a wrong declared type; other valid hits are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import arrow_map, chunks, spread

BLOCK = 64
SAMPLE_RATE = 8000
WAV_HEADER = 44


def wav_of(payload: bytes) -> bytes:
    """An 8-bit mono PCM file whose samples are the payload's bytes."""
    pad = len(payload) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + 24 + 8 + len(payload) + pad, b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + bytes(pad)


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the block."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


class Value:
    """A value with what validators look up in it, so that many hits cost no more than one pass.

    ``marks`` are the places of closing strings. ``follow`` walks a chain of structures from
    a position and remembers where every position on it leads.
    """

    def __init__(self, raw: bytes, marks: dict[bytes, list[int]]):
        self.raw, self.marks = raw, marks
        self.ends: dict[object, dict[int, int | None]] = {}

    def after(self, mark: bytes, at: int) -> int | None:
        places = self.marks.get(mark, ())
        i = bisect_left(places, at)
        return places[i] if i < len(places) else None

    def follow(self, step, at: int) -> int | None:
        """Where the chain from ``at`` ends, or None if it breaks; ``step`` gives (position, whether that is the end) or None."""
        known = self.ends.setdefault(step, {})
        walked = []
        while at not in known:
            walked.append(at)
            found = step(self.raw, at)
            if found is None or found[1]:
                known[at] = None if found is None else found[0]
                break
            at = found[0]
        for place in walked:
            known[place] = known[at]
        return known[at]


# Each validator takes a value and the start of a hit and returns (end, media type), with the start if it
# lies before the hit, or None. A step takes bytes and a position and returns the next position and whether
# the chain ends there, or None.


def _riff(value: Value, at: int):
    b = value.raw
    if len(b) < at + 12:
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    kinds = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}
    if form not in kinds or size < 4 or end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        tag, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        if tag == b"fmt " and n < 16:
            return None
        seen.add(tag)
        p += 8 + n + n % 2
    if p != end or form == b"WAVE" and not {b"fmt ", b"data"} <= seen:
        return None
    return end, kinds[form]


def _png_chunk(b: bytes, p: int):
    if p + 12 > len(b):
        return None
    n, tag = struct.unpack_from(">I4s", b, p)
    end = p + 12 + n
    if end > len(b) or not tag.isalpha() or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
        return None
    return end, tag == b"IEND"


def _png(value: Value, at: int):
    if value.raw[at + 8 : at + 16] != b"\x00\x00\x00\rIHDR":
        return None
    end = value.follow(_png_chunk, at + 8)
    return (end, "image/png") if end else None


def _sub_block(b: bytes, p: int):
    return (p + 1 + b[p], b[p] == 0) if p < len(b) else None


def _gif(value: Value, at: int):
    b = value.raw

    def block(_, p: int):
        kind = b[p] if p < len(b) else 0
        if kind == 0x3B:
            return p + 1, True
        if kind == 0x21:
            p = value.follow(_sub_block, p + 2)
        elif kind == 0x2C and p + 10 < len(b):
            p = value.follow(_sub_block, p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return None
        return None if p is None else (p, False)

    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    step = value.ends.setdefault("gif block", block)
    end = value.follow(step, at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
    return (end, "image/gif") if end else None


def _jpeg_segment(b: bytes, p: int):
    if p + 4 > len(b) or b[p] != 0xFF:
        return None
    mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
    if mark in (0, 0xFF) or 0xD0 <= mark <= 0xD9 or n < 2:
        return None
    p += 2 + n
    if mark == 0xDA:
        while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
            if b[p + 1] == 0xD9:
                return p + 2, True
            if b[p + 1] not in (0, *range(0xD0, 0xD8)):
                break
            p += 2
        if p < 0:
            return None
    return p, False


def _jpeg(value: Value, at: int):
    end = value.follow(_jpeg_segment, at + 2)
    return (end, "image/jpeg") if end else None


def _bmp(value: Value, at: int):
    b = value.raw
    if len(b) < at + 30:
        return None
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    ok = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return (at + size, "image/bmp") if ok and 14 + header <= offset <= size and at + size <= len(b) else None


def _flac_block(b: bytes, p: int):
    if p + 4 > len(b):
        return None
    end = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    if b[p] & 0x7F == 127 or end > len(b):
        return None
    return end, bool(b[p] & 0x80)


def _flac(value: Value, at: int):
    """Metadata blocks, the first about the stream, then a frame; the format has no length, so it reaches to the value's end."""
    b = value.raw
    if b[at + 4 : at + 8].lstrip(b"\x80") not in (b"\x00\x00\x00\x22", b"\x00\x00\x22") or at + 42 > len(b):
        return None
    end = value.follow(_flac_block, at + 4)
    ok = end and end + 2 <= len(b) and b[end] == 0xFF and b[end + 1] & 0xFC == 0xF8
    return (len(b), "audio/flac") if ok else None


def _ogg_page(b: bytes, p: int):
    if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4]:
        return p, True  # the stream ends before what is no page
    n = b[p + 26]
    end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
    return None if p + 27 + n > len(b) or end > len(b) else (end, False)


def _ogg(value: Value, at: int):
    end = value.follow(_ogg_page, at)
    return (end, "application/ogg") if end and end > at else None


def _mp4_box(b: bytes, p: int):
    if p + 8 > len(b):
        return p, True
    n, kind = struct.unpack_from(">I4s", b, p)
    if n < 8 or p + n > len(b) or not kind.isalnum():
        return p, True
    return p + n, False


def _mp4(value: Value, hit: int):
    at = hit - 4
    end = value.follow(_mp4_box, at) if at >= 0 else None
    return (end, "video/mp4", at) if end and end > at + 16 else None


def _pdf(value: Value, at: int):
    end, table = value.after(b"%%EOF", at), value.after(b"startxref", at)
    return (end + 5, "application/pdf") if end is not None and table is not None and table + 9 <= end else None


def _zip(value: Value, at: int):
    b, end = value.raw, value.after(b"PK\x05\x06", at)
    if end is None or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    ok = at + start + size == end and end + 22 + note <= len(b)
    return (end + 22 + note, "application/zip") if ok else None


# Magic strings of the formats' public specifications, and strings that close a format.
MAGIC = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"fLaC": _flac,
    b"OggS": _ogg,
    b"ftyp": _mp4,
    b"%PDF-": _pdf,
    b"PK\x03\x04": _zip,
}
CLOSING = (b"%%EOF", b"startxref", b"PK\x05\x06")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in (*MAGIC, *CLOSING):
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff_bytes(raw: bytes) -> list[tuple[str, int, int]]:
    """(media type, start, length) of every valid format in the value, by start; outer ones first."""
    hits, marks = [], {}
    for last, magic in _automaton().iter(raw.decode("latin-1")):
        at = last + 1 - len(magic)
        if magic in MAGIC:
            hits.append((at, magic))
        else:
            marks.setdefault(magic, []).append(at)
    value, found = Value(raw, marks), []
    for at, magic in hits:
        if hit := MAGIC[magic](value, at):
            start = hit[2] if len(hit) > 2 else at
            found.append((hit[1], start, hit[0] - start))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def wav_samples(value: bytes) -> bytes:
    """The data chunk of a valid 8-bit PCM file."""
    p = 12
    while p + 8 <= len(value):
        tag, n = struct.unpack_from("<4sI", value, p)
        if tag == b"data":
            return value[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("declared", T.StringType()),
        T.StructField("media", T.BinaryType()),
    ]
)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes as the samples of an 8-bit WAV value, with an untrue declared type.

    A null text is an empty one; an empty text becomes one block of zero bytes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in chunks(batches, "text"):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield {
                "doc_id": batch.column(0),
                "n_bytes": [len(x) for x in raw],
                "declared": ["application/octet-stream"] * len(raw),
                "media": [wav_of(padded(x)) for x in raw],
            }

    return arrow_map(spread(rows), run, STORED)


SPAN = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])


def sniff_media(
    df: DataFrame, media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = (), carve: bool = True
) -> DataFrame:
    """Adds to the columns ``keep``: media_type (found, else the declared type, else null), corrected, length, carved.

    ``carved`` lists the valid media that start inside the value or follow its own end,
    as (type, start, length, bytes), outermost only. A null or empty value has the declared type, length 0 and
    nothing carved. Rows stay as they are, ties and repeats included; columns named like
    the results must not be in ``keep``.
    """
    part = T.StructType([*SPAN.fields, T.StructField("bytes", T.BinaryType())])
    own = [
        T.StructField("media_type", T.StringType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("length", T.LongType()),
        T.StructField("carved", T.ArrayType(part)),
    ]
    rows = df.select(F.col(media_col).alias("__media"), F.col(declared_col).cast("string").alias("__declared"), *keep)
    schema = T.StructType([*(df.schema[k] for k in keep), *own])

    def run(batches):
        for batch in chunks(batches, "__media"):
            out = {k: batch.column(batch.schema.get_field_index(k)) for k in keep} | {f.name: [] for f in own}
            for value, declared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, length, carved = inspect(value, declared)
                out["media_type"].append(kind)
                out["corrected"].append(kind != declared)
                out["length"].append(length)
                out["carved"].append([{"type": t, "start": s, "length": n, "bytes": value[s : s + n]} for t, s, n in carved] if carve else [])
            yield out

    return arrow_map(rows, run, schema)


def inspect(value: bytes | None, declared: str | None) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """The value's type and own length, and the outermost media carved from it."""
    if not value:
        return declared, 0, []
    found = sniff_bytes(value)
    kind, length, after = declared, len(value), 0
    if found and found[0][1] == 0:
        (kind, _, length), found = found[0], found[1:]
    carved = []
    for hit in found:
        if hit[1] >= after:
            carved.append(hit)
            after = hit[1] + hit[2]
    return kind, length, carved


FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def read_features(stored: DataFrame) -> DataFrame:
    """Sniffs the stored values, reads their samples back and describes them.

    The feature holds the sniffed type, what it was declared as, the number of samples,
    their mean and deviation in hundredths, and what was carved; equal values give
    equal features.
    """

    def run(batches):
        for batch in chunks(batches, "media"):
            out: dict = {f.name: [] for f in FEATURES}
            for doc, n, declared, value in zip(*(c.to_pylist() for c in batch.columns)):
                kind, length, carved = inspect(value, declared)
                if kind != "audio/wav":
                    raise ValueError(f"stored value reads as {kind}")
                samples = wav_samples(value[:length])
                levels = np.frombuffer(samples, "u1")
                spans = ",".join(f"{t}@{s}+{k}" for t, s, k in carved)
                out["doc_id"].append(doc)
                out["n_bytes"].append(n)
                out["payload_bytes"].append(len(samples))
                out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(zlib.crc32(samples[-BLOCK:]))
                out["media_bytes"].append(len(value))
                out["media_sha256"].append(hashlib.sha256(value).hexdigest())
                out["feature"].append(f"{kind};declared={declared};samples={levels.size};mean={round(100 * levels.mean())};sd={round(100 * levels.std())};carved=[{spans}]")
            yield out

    return arrow_map(stored.select("doc_id", "n_bytes", "declared", "media"), run, FEATURES)
