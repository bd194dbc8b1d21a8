"""Media columns: payloads in archives, read back by a custom Spark data source (operator 10).

Writing: every task packs its payloads as PNG images (8-bit grey samples, 576 a row) into
archives of its own in the shared folder and returns one manifest row an archive.  Only
archives that the manifest names count, so a retried task leaves nothing behind.

An archive is the members' bytes one after the other, then its directory (fixed-size
entries: offset, length, CRC-32, key) and a fixed-size trailer that locates it.

Reading: the ``media_archive`` data source plans partitions of about ``partitionBytes``
over the archive directories named by the manifest.  A partition reads the part of the
directory whose members begin in its byte range, streams the members as Arrow batches of
bounded bytes, and reads each member by its own offset; a member whose bytes are short or
whose CRC differs is read again by itself, up to ``retries`` times, before the task fails.

Defined results: null and empty texts are one row of padding; equal texts have equal
bytes, so equal values; repeated rows are repeated; a text of any length is one member
(chunks bound what is held beside it); an empty table gives no archive and no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import arrow_map, lean, only, shared_dir, staged, text_chunks, utf8

ROW = 576
PAD = 255
ENTRY = struct.Struct("<qqI?q")  # offset, length, CRC-32, whether there is a key, key
TRAILER = struct.Struct("<8sqq")  # magic, where the directory begins, how many entries
MAGIC = b"MEDIAAR1"
BATCH_BYTES = 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def payload(text: bytes) -> bytes:
    """Padded with 255 to a positive multiple of the row length."""
    size = max(ROW, -(-len(text) // ROW) * ROW)
    return text + bytes([PAD]) * (size - len(text))


def encode(data: bytes, level: int = 1) -> bytes:
    """A greyscale PNG with ROW samples a row and filter type none."""
    rows = np.zeros((len(data) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, ROW)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode(image: bytes) -> np.ndarray:
    """The samples of such a PNG, rows x ROW; every chunk's CRC is checked."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], None
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"bad CRC in {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += size + 12
    if shape is None or shape[0] != ROW or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image of this width")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], ROW + 1)
    if rows[:, 0].any():
        raise ValueError("rows are filtered")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Rows, mean and deviation (in 1/1000, floored) and a 64-bit average hash, all in whole numbers."""
    flat = samples.astype(np.int64)
    n, total = flat.size, int(flat.sum())
    squares = int((flat * flat).sum())
    variance = (squares * n - total * total) * 1_000_000 // (n * n)
    columns = flat.reshape(len(flat), 64, ROW // 64).sum(axis=(0, 2))
    bits = "".join("1" if int(c) * 64 > total else "0" for c in columns)
    root = int(np.sqrt(np.float64(variance)))
    while root * root > variance:
        root -= 1
    return f"{len(flat)}:{total * 1000 // n}:{root}:{int(bits, 2):016x}"


def _write(folder: str, batches):
    """One task's archive: a row (path, bytes, members), or none if the task has no rows."""
    path, entries, at, out = f"{folder}/{uuid.uuid4().hex}.mar", [], 0, None
    for batch in batches:
        for chunk in text_chunks(batch):
            data, offsets = utf8(chunk["text"])
            raw = data.tobytes()
            for key, a, b in zip(chunk["doc_id"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if out is None:
                    system, name = _file(path)
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(name)
                image = encode(payload(raw[a:b]))
                out.write(image)
                entries.append(ENTRY.pack(at, len(image), zlib.crc32(image), key is not None, key or 0))
                at += len(image)
    if out is not None:
        for i in range(0, len(entries), 65_536):
            out.write(b"".join(entries[i : i + 65_536]))
        out.write(TRAILER.pack(MAGIC, at, len(entries)))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([at + len(entries) * ENTRY.size + TRAILER.size]), pa.array([len(entries)])],
            ["path", "bytes", "members"],
        )


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """The manifest (path, bytes, members) of what was written; staged, so written once."""
    return staged(only(docs, "doc_id", "text").mapInArrow(lean(partial(_write, folder)), "path string, bytes long, members long"))


def listed(manifest: str) -> list[tuple[str, int]]:
    """path and bytes of the archives that the Parquet files in a manifest's folder name."""
    if not manifest:
        return []
    system, name = _file(manifest)
    rows = ds.dataset(name, filesystem=system, format="parquet").to_table(columns=["path", "bytes"])
    return sorted(zip(rows["path"].to_pylist(), rows["bytes"].to_pylist(), strict=True))


class ByteRange(InputPartition):
    """Members of one archive that begin at start <= offset < end."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.manifest = options.get("manifest", "")
        self.bytes = int(options.get("partitionbytes", 16 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        return [ByteRange(path, at, min(at + self.bytes, size)) for path, size in listed(self.manifest) for at in range(0, size, self.bytes)]

    def read(self, partition):
        if partition is None:  # no archive at all
            return
        system, name = _file(partition.path)
        source = system.open_input_file(name)
        magic, directory, count = TRAILER.unpack(source.read_at(TRAILER.size, source.size() - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{partition.path} is no archive")

        def first_at(offset: int) -> int:
            """The first entry whose member begins at or after offset; entries are of one size and in order."""
            low, high = 0, count
            while low < high:
                mid = (low + high) // 2
                begins = ENTRY.unpack(source.read_at(ENTRY.size, directory + mid * ENTRY.size))[0]
                low, high = (mid + 1, high) if begins < offset else (low, mid)
            return low

        low, high = first_at(partition.start), first_at(partition.end)
        keys, found, size = [], [], 0
        for i in range(low, high, 65_536):
            part = source.read_at(min(65_536, high - i) * ENTRY.size, directory + i * ENTRY.size)
            for offset, length, crc, has_key, key in ENTRY.iter_unpack(part):
                keys.append(key if has_key else None)
                found.append(read_member(system, name, source, offset, length, crc, self.retries))
                size += length
                if size >= BATCH_BYTES:
                    yield self._batch(keys, found)
                    keys, found, size = [], [], 0
        if keys:
            yield self._batch(keys, found)

    @staticmethod
    def _batch(keys, found):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "media"])


def read_member(system, name: str, source, offset: int, length: int, crc: int, retries: int) -> bytes:
    """One member by its own offset; after a failure the file is opened anew."""
    for attempt in range(retries + 1):
        try:
            if attempt:
                time.sleep(0.05 * 2**attempt)
                with system.open_input_file(name) as again:
                    data = again.read_at(length, offset)
            else:
                data = source.read_at(length, offset)
            if len(data) == length and zlib.crc32(data) == crc:
                return data
        except OSError:
            if attempt == retries:
                raise
    raise OSError(f"{name}: the member at {offset} is damaged")


class ArchiveSource(DataSource):
    """spark.read.format("media_archive"): key and media of every member."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "key long, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: DataFrame, partition_bytes: int = 16 << 20) -> DataFrame:
    """key and media of all archives of a staged manifest; the plan has its folder, and planning reads a path and size an archive."""
    spark.dataSource.register(ArchiveSource)
    files = manifest.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    return spark.read.format("media_archive").option("manifest", folder).option("partitionBytes", partition_bytes).load()


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for key, cell in zip(batch["key"].to_pylist(), batch["media"], strict=True):
        image = cell.as_py()
        samples = decode(image)
        data = samples.tobytes()
        # UTF-8 never has the byte 255, so the padding is what follows the text
        n = len(data.rstrip(bytes([PAD])))
        rows.append((key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text as an image in archives, read those back and describe each."""
    spark = docs.sparkSession
    manifest = write_archives(docs, f"{shared_dir(spark)}/archives")
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string"
    )
    return arrow_map(read_archives(spark, manifest), schema, _features)
