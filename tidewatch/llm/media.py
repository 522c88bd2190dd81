"""Media columns: payloads in archives, read by a custom Spark data source.

An archive is a ZIP file with stored members, so any tool can open it; a member
is a payload, here an 8-bit greyscale PNG that also tells how long its text was. An index
beside each archive (Parquet) has every member's offset, size, CRC and key. The data
source ``archive`` plans partitions as byte ranges over the archives of a folder. A
partition reads the index rows of the members whose local headers begin in its range
and streams their payloads as Arrow batches of bounded size. Every member is read by
its own offset and checked against its CRC; a failed read is tried again for that
member alone.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import pieces, scratch, take, texts

WIDTH = 64  # samples in a row of an image; payloads are padded to whole rows
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 8 << 20
TRIES, PAUSE = 3, 0.2
_HEADER = 30  # bytes of a ZIP local header before the name
_LENGTH = b"tdLn"  # ancillary, private, safe to copy
_INDEX = pa.schema([("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("key", pa.string())])
INDEX_ROWS = 4096  # rows of an index that are read together


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, length: int) -> bytes:
    """A payload of whole rows as a greyscale PNG: one byte, one sample; a private chunk has the length without padding."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(_LENGTH, struct.pack(">Q", length)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_image(png: bytes) -> tuple[np.ndarray, int]:
    """The samples, row by row, of an image that ``encode_image`` can write, and the length without padding."""
    at, body, shape, length = 8, [], None, None
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack_from(">IIBBBBB", png, at + 8)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale images without interlace")
            shape = height, width + 1
        elif kind == _LENGTH:
            (length,) = struct.unpack_from(">Q", png, at + 8)
        elif kind == b"IDAT":
            body.append(png[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter")
    samples = lines[:, 1:].reshape(-1)
    return samples, len(samples) if length is None else length


def pad(text: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 0 up to a positive multiple of ``unit``."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def features(samples: np.ndarray) -> str:
    """Mean, deviation, zero-crossing rate about the mean and the power shares of eight frequency bands."""
    x = samples.astype(np.float64)
    centred = x - x.mean()
    power = (np.abs(np.fft.rfft(x.reshape(-1, WIDTH) - 128.0, axis=1)) ** 2).mean(0)[1:]
    bands = power.reshape(8, -1).sum(1)
    shares = bands / bands.sum() if bands.sum() > 0 else bands
    crossings = np.mean(np.signbit(centred[1:]) != np.signbit(centred[:-1])) if len(x) > 1 else 0.0
    return json.dumps({"mean": round(float(x.mean()), 4), "std": round(float(x.std()), 4), "zcr": round(float(crossings), 4), "bands": [round(float(s), 4) for s in shares]}, separators=(",", ":"))


class _Archive:
    """Archives of one task; a new file begins when one is full."""

    def __init__(self, folder: str, most: int):
        self.store, self.root = open_store(folder)
        self.most, self.file, self.zip, self.done = most, None, None, []

    def add(self, key: str | None, body: bytes) -> None:
        if self.zip is None:
            context = TaskContext.get()
            self.name = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}.zip"
            self.store.create_dir(self.root, recursive=True)
            self.file = self.store.open_output_stream(f"{self.root}/{self.name}")
            self.zip, self.size, self.index = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED), 0, []
        info = zipfile.ZipInfo(f"{len(self.index):08d}.png")
        self.zip.writestr(info, body)
        self.index.append((info.filename, info.header_offset, len(body), info.CRC, key))
        self.size += len(body) + 128
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.file.close()
            rows = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.index, strict=True), _INDEX, strict=True)], schema=_INDEX)
            with self.store.open_output_stream(f"{self.root}/{self.name}.index") as file:
                pq.write_table(rows, file, row_group_size=INDEX_ROWS)
            self.done.append((self.name, self.store.get_file_info(f"{self.root}/{self.name}").size, len(self.index)))
            self.zip = None


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stores every text as an image member and returns the manifest (archive, bytes, members), written to the folder.

    A task names its files afresh in every attempt and reports them only when
    done, and Spark commits one report per task: files of failed or speculative
    attempts aren't in the manifest and are never read. Null texts are empty.
    Ids are in the index as text, of any length and with any character; repeated and
    null ids are kept.
    """
    spark = docs.sparkSession

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder, archive_bytes)
        for batch in batches:
            for part in pieces(batch):
                for key, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                    archive.add(key, encode_image(pad(text), len(text)))
        archive.close()
        columns = list(zip(*archive.done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "bytes", "members"])

    manifest = take(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(store, "archive string, bytes long, members long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the committed archives, by the manifest: no archive is opened here."""
        store, root = open_store(self.folder)
        parts = [f for f in store.get_file_info(fs.FileSelector(f"{root}/manifest")) if f.path.endswith(".parquet")]
        found = []
        for part in parts:
            with store.open_input_file(part.path) as file:
                rows = pq.read_table(file)
            found += zip(rows["archive"].to_pylist(), rows["bytes"].to_pylist(), strict=True)
        return [ByteRange(name, at, min(size, at + self.range_bytes)) for name, size in sorted(found) for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, root = open_store(self.folder)
        path = f"{root}/{partition.archive}"
        found, payloads, held = [], [], 0
        for row in self._retry(lambda: self._members(store, path, partition)):
            body = self._retry(lambda row=row: self._member(store, path, row))
            found.append(row)
            payloads.append(body)
            held += len(body)
            if held >= self.batch_bytes:
                yield self._batch(found, payloads)
                found, payloads, held = [], [], 0
        self.close()
        if found:
            yield self._batch(found, payloads)

    def _members(self, store, path: str, partition: ByteRange) -> list[dict]:
        """The index rows of a byte range; row groups of other ranges are skipped by their bounds."""
        inside = (ds.field("offset") >= partition.start) & (ds.field("offset") < partition.stop)
        return ds.dataset(f"{path}.index", filesystem=store, format="parquet").to_table(filter=inside).to_pylist()

    _file = None

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None

    def _member(self, store, path: str, row: dict) -> bytes:
        """One member by its offset, from a file handle that is opened again after a failure."""
        try:
            if self._file is None:
                self._file = store.open_input_file(path)
            head = self._file.read_at(_HEADER, row["offset"])
            name, extra = struct.unpack_from("<HH", head, 26)
            body = self._file.read_at(row["size"], row["offset"] + _HEADER + name + extra)
            if head[:4] != b"PK\x03\x04" or zlib.crc32(body) != row["crc"]:
                raise OSError(f"{path}: member at {row['offset']} is damaged")
            return body
        except Exception:
            self.close()
            raise

    def _retry(self, action):
        for left in reversed(range(self.tries)):
            try:
                return action()
            except (OSError, zipfile.BadZipFile, struct.error, pa.ArrowException):
                if not left:
                    raise  # the task fails and Spark runs it again elsewhere; no member is dropped
                time.sleep(PAUSE)

    @staticmethod
    def _batch(found: list[dict], payloads: list[bytes]) -> pa.RecordBatch:
        names = [pa.array([r[c] for r in found], pa.string()) for c in ("member", "key")]
        return pa.RecordBatch.from_arrays([*names, pa.array(payloads, pa.binary())], ["member", "key", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(folder)``: name, key and payload of every member."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "member string, key string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, payload (read back), media, feature of every row.

    Texts go to archives first; everything returned comes from the archives.
    Null texts are stored as one row of zeros, like empty ones; null ids stay null.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    write_archives(docs, folder, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media"):
                images = [decode_image(m) for m in part.column("media").to_pylist()]
                columns = [pa.array([n for _, n in images], pa.int64()), pa.array([s.tobytes() for s, _ in images], pa.binary()), pa.array([features(s) for s, _ in images])]
                yield pa.RecordBatch.from_arrays([part.column("key"), columns[0], columns[1], part.column("media"), columns[2]], ["key", "n_bytes", "payload", "media", "feature"])

    read = read_archives(spark, folder).mapInArrow(decode, "key string, n_bytes long, payload binary, media binary, feature string")
    return read.select(F.col("key").cast(kind).alias("doc_id"), "n_bytes", "payload", "media", "feature")
