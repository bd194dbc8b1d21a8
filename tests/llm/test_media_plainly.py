"""What is stored, and the feature of it, by other means."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from fractions import Fraction

from docsieve.llm import media


def samples_of(image):
    """The samples of an 8-bit grey PNG, read chunk by chunk."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, body, width, height = 8, b"", 0, 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        assert struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + data)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", data[:10])
            assert (depth, colour) == (8, 0)
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(body)
    assert len(raw) == height * (width + 1)
    return b"".join(raw[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(height))


def plain_feature(data):
    n, total = len(data), sum(data)
    mean = Fraction(total, n)
    variance = sum((Fraction(x) - mean) ** 2 for x in data) / n
    columns = [sum(data[i] for i in range(n) if i % 576 // 9 == c) for c in range(64)]
    bits = "".join("1" if c * 64 > total else "0" for c in columns)
    return f"{n // 576}:{math.floor(1000 * mean)}:{math.isqrt(math.floor(variance * 1_000_000))}:{int(bits, 2):016x}"


def test_media_against_plain_reading(spark):
    rng = random.Random(1)
    texts = ["", None, "x", "ünï" * 400, "".join(rng.choice("abcdefgh \n") for _ in range(1_500)), "y" * 576]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = media.encode(data)
        assert samples_of(image) == data and r.media_sha256 == hashlib.sha256(image).hexdigest() and r.media_bytes == len(image)
        assert r.feature == plain_feature(data)
