import hashlib
import io
import struct
import wave
import zipfile
import zlib

import pytest

from lacuna.llm import media, queries


def png():
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"\x12\xff\x00\x34\xff\xd9"


def pdf():
    return b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


def ogg():
    return b"OggS\0\x02" + bytes(20) + b"\x01\x05" + b"hello"


def flac():
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34) + b"\xff\xf8abc"


def mp4():
    return struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 12) + b"mdat" + b"abcd"


FORMATS = {"image/png": png, "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/pdf": pdf, "application/zip": zipped, "application/ogg": ogg, "audio/flac": flac, "video/mp4": mp4, "audio/wav": lambda: media.wav_of(b"abcd")}


@pytest.mark.parametrize("kind", FORMATS)
def test_types_are_found_and_corrected(kind):
    value = FORMATS[kind]()
    assert media.inspect(value, "text/plain") == (kind, len(value), [])


@pytest.mark.parametrize("kind", [k for k in FORMATS if k != "audio/flac"])
def test_media_are_carved_from_within(kind):
    inner = FORMATS[kind]()
    value = b"some text RIFF GIF89a BM \x89PNG " + inner + b" and more PK\x03\x04 %PDF- OggS"
    found = media.inspect(value, "x")
    assert found[0] == "x" and (kind, 30, len(inner)) in found[2]


@pytest.mark.parametrize("kind", ["image/png", "image/gif", "image/bmp", "audio/wav", "application/zip"])
def test_broken_structure_is_not_media(kind):
    value = FORMATS[kind]()
    assert media.inspect(value[:-3], "x")[0] == "x"


def test_wav_reads_elsewhere():
    payload = media.padded("é text".encode())
    with wave.open(io.BytesIO(media.wav_of(payload))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)


def test_features(spark, odd, odd_rows):
    got = media.read_features(media.store_texts(odd)).collect()
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44, hashlib.sha256(media.wav_of(payload)).hexdigest()))
    assert sorted(map(repr, [tuple(r)[:-1] for r in got])) == sorted(map(repr, want))
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, r.feature) == r.feature


def test_sniffing_a_column(spark):
    rows = [(1, bytearray(png()), "image/gif"), (2, None, "a/b"), (3, bytearray(b""), None), (4, bytearray(b"GIF89a is just text"), "text/plain"), (5, bytearray(media.wav_of(png() + b"\0")), None), (5, bytearray(media.wav_of(png() + b"\0")), None)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, declared string")
    got = sorted(((r.doc_id, r.media_type, r.corrected, r.length, [(c.type, c.start, bytes(c.bytes) == png()) for c in r.carved]) for r in media.sniff_media(df, keep=("doc_id",)).collect()), key=repr)
    inner = [("image/png", 44, True)]
    wav = (5, "audio/wav", True, 44 + len(png()) + 1 + (len(png()) + 1) % 2, inner)
    assert got == [(1, "image/png", True, len(png()), []), (2, "a/b", False, 0, []), (3, None, False, 0, []), (4, "text/plain", False, 19, []), wav, wav]


def test_empty_table(none):
    assert media.read_features(media.store_texts(none)).count() == 0


def test_query_covers_all_documents(spark, small):
    assert queries.op10_media_columns(spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_many_hits_take_linear_time():
    import time

    for pattern in (b"%PDF-", b"PK\x03\x04", b"GIF89a!!", b"OggS\0", b"RIFF    WAVE", b"\0\0\0\x10ftypabcdefgh"):
        value = media.wav_of(media.padded(pattern * (2_000_000 // len(pattern))))
        began = time.time()
        assert media.inspect(value, None)[0] == "audio/wav"
        assert time.time() - began < 20, pattern


def test_flac_needs_its_stream_block_and_a_frame():
    stream = struct.pack(">HH", 4096, 4096) + bytes(6) + (44100 << 12).to_bytes(4, "big") + bytes(20)
    good = b"fLaC" + b"\x80\x00\x00\x22" + stream + b"\xff\xf8" + bytes(50)
    assert media.sniff_bytes(good) == [("audio/flac", 0, len(good))]
    assert media.sniff_bytes(good[:42] + b"\xff\x00" + bytes(50)) == [] == media.sniff_bytes(b"fLaC" + bytes(80))


def test_query_digests(spark, small, some_texts):
    got = {r.doc_id: r for r in queries.op10_media_columns(spark, small).collect()}
    for i, text in some_texts:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav_of(payload)).hexdigest() and r.media_bytes == len(payload) + 44
