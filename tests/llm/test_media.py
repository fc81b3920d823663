import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

from sievework.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00;"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    ogg = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
    return {"image/png": png(), "application/zip": z.getvalue(), "image/bmp": bmp, "image/gif": gif, "application/pdf": pdf, "audio/ogg": ogg, "application/gzip": gzip.compress(b"x" * 99), "audio/wav": media.to_wave(b"abc")}


def test_types_and_carving():
    for kind, body in samples().items():
        assert media.items(body) == [media.Item(kind, 0, len(body))]
        assert media.items(b"junk" + body + b"rest") == [media.Item(kind, 4, 4 + len(body))]
        assert not [x for x in media.items(body[:-3]) if x.end > len(body) - 3 or x.start == 0]
    inner = media.to_wave(b"--" + png() + b"--" + samples()["application/pdf"])
    assert [x.kind for x in media.items(inner)] == ["audio/wav", "image/png", "application/pdf"]
    assert media.items(b"") == [] and media.items(b"BM RIFF %PDF-") == []


def test_hostile_input_is_linear():
    """Many starts, with and without an end mark far behind them; four times the length takes no sixteen times as long."""
    jpeg = b"\xff\xd8\xff\xe0\x00\x02"
    parts = [(b"%PDF-1", b"startxref%%EOF"), (b"PK\x03\x04", b"PK\x05\x06" + bytes(18)), (b"BM", b""), (b"RIFF", b""), (b"RIFF\x40\x00\x00\x00", b""), (b"GIF89a", b"\x3b"), (b"GIF89a" + bytes(7) + b"!\xf9\x01\x00\x00", b""), (b"\x89PNG\r\n\x1a\n", b"IEND"), (jpeg, b"\xff\xd9"), (jpeg[:4] + b"\x00\x04", b"\xff\xda\xff\xd9"), (b"OggS" + bytes(22) + b"\x01\x00", b"")]
    for part, end in parts:
        times = []
        for n in (10_000, 40_000):
            data = part * n + end
            began = time.process_time()
            media.items(data)
            times.append(time.process_time() - began)
        assert times[1] < 8 * times[0] + 0.5, (part, times)


def test_updated_documents_and_nested_archives():
    body = samples()["application/pdf"]
    updated = body + b"\n2 0 obj\nendobj\nstartxref\n44\n%%EOF"
    assert media.items(updated) == [media.Item("application/pdf", 0, len(updated))]
    assert [x.end - x.start for x in media.items(b".." + updated + b"\n" + body)] == [len(updated), len(body)]
    inner, outer = samples()["application/zip"], io.BytesIO()
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as f:
        f.writestr("inner.zip", inner)
    whole = outer.getvalue()
    assert media.items(b"x" + whole) == [media.Item("application/zip", 1, 1 + len(whole))]
    assert media.items(whole)[0] == media.Item("application/zip", 0, len(whole))


def test_wave_is_a_wave():
    with wave.open(io.BytesIO(media.to_wave(bytes(range(256))))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(999)) == (1, 1, bytes(range(256)))


def test_rows(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 5000]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)] + [(None, "a", b"z")], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in media.media_digest(media.store_as_wave(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(media.to_wave(payload))
    assert got[None].feature == got[2].feature
    rows = spark.createDataFrame([(1, "image/jpeg", png()), (2, "image/png", b"nothing"), (3, None, None), (4, "x", b"ab" + png())], "doc_id long, declared string, media binary")
    found = {r.doc_id: (r.sniffed, r.corrected, [(x.kind, bytes(x.body)) for x in r.embedded]) for r in media.sniff_media(rows).collect()}
    assert found == {1: ("image/png", "image/png", []), 2: (None, "image/png", []), 3: (None, None, []), 4: (None, "x", [("image/png", png())])}
    assert media.sniff_media(rows.limit(0)).count() == 0
