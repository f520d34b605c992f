"""Media columns: payloads as grey-scale images in archive directories, read by a data source.

``write_archives`` stores each payload (a text's UTF-8 bytes, then zero bytes up to a positive
multiple of 64) as an 8-bit grey PNG, 64 samples wide, so that the stored form is lossless and
smaller than the text.  Each task writes one archive: members one after another (id, unpadded size,
image size, image), then a table of their offsets and an 8-byte count.  An archive is written under
a name of its own and then renamed to the partition's, so that a task that runs twice leaves one.

``ArchiveSource`` is a Spark data source: it lists the directory, plans byte ranges, reads of each
range the members that begin in it, in Arrow batches of bounded size, and tries each member again
by its own offset if a read fails, without the rest of the range.

Null text: empty payload, stored as 64 zero bytes.  Equal texts give equal values.  A very long text
is one member, read whole by one range.  Repeated ids are members of their own.  An empty table
gives archives without members, and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import shared as S

ROW = 64
BLOCK = 1 << 20  # bytes of an archive that are read or written at once
RANGE = 16 << 20  # bytes of an archive that one task reads
BATCH = 4 << 20  # payload bytes of an Arrow batch, or one member
TRIES = 4
_HEAD, _HEAD_SIZE = "<qqq", 24  # id, unpadded bytes, image bytes
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(data: bytes, level: int = 1) -> bytes:
    """A grey 8-bit PNG of 64 columns; each row is stored with filter type 0."""
    rows = len(data) // ROW
    raw = np.zeros((rows, ROW + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """Samples of a PNG that :func:`to_image` wrote; every chunk's checksum is verified."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width = 8, [], 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", data)
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("another sample format")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)
    if raw[:, 0].any():
        raise ValueError("another row filter")
    return raw[:, 1:].tobytes()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        context = TaskContext.get()
        part = context.partitionId()
        temporary = f"{root}/_{part:06d}-{context.taskAttemptId()}"
        offsets, at = [], 0
        with store.open_output_stream(temporary, buffer_size=BLOCK) as out:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = batch.column(1)
                for i, key in enumerate(ids):
                    text = texts[i].as_buffer()
                    text = text.to_pybytes() if text is not None else b""
                    image = to_image(payload(text))
                    out.write(struct.pack(_HEAD, key if key is not None else -(2**63), len(text), len(image)))
                    out.write(image)
                    offsets.append(at)
                    at += _HEAD_SIZE + len(image)
            out.write(np.array(offsets, "<i8").tobytes())
            out.write(struct.pack("<q", len(offsets)))
        final = f"{root}/part-{part:06d}.members"
        if store.get_file_info(final).type == fs.FileType.File:
            store.delete_file(temporary)  # an earlier try of this task ended: its archive holds the same members
        else:
            store.move(temporary, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([len(offsets)], pa.int64())], ["archive", "members"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the archives of all texts under ``folder`` and returns the number of members."""
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    written = texts.mapInArrow(_writer(folder), "archive string, members long")
    return written.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


class ByteRange(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int):
        super().__init__(None)
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", RANGE))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self):
        store, root = _open(self.folder)
        found = store.get_file_info(fs.FileSelector(root))
        files = sorted((f.path, f.size) for f in found if f.base_name.endswith(".members"))
        ranges = [ByteRange(p, n, a, min(n, a + self.range)) for p, n in files for a in range(0, n, self.range)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def _again(self, archive: str, offset: int, size: int) -> bytes:
        """``size`` bytes from ``offset`` on, by a fresh handle at each try."""
        for k in range(self.tries):
            try:
                store, _ = _open(self.folder)
                with store.open_input_file(archive) as f:
                    data = f.read_at(size, offset)
                if len(data) == size:
                    return data
                raise OSError(f"{len(data)} of {size} bytes at {offset}")
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(0.05 * 2**k)
        raise OSError("unreachable")

    def _member(self, archive: str, offset: int, block: bytes | None, base: int) -> tuple[int, int, bytes, bytes]:
        """Id, unpadded size, image and samples of one member; a bad copy is read again on its own."""
        for k in range(self.tries):
            try:
                if block is not None and base <= offset and offset + _HEAD_SIZE <= base + len(block):
                    head = block[offset - base : offset - base + _HEAD_SIZE]
                else:
                    head = self._again(archive, offset, _HEAD_SIZE)
                key, n_bytes, size = struct.unpack(_HEAD, head)
                at = offset + _HEAD_SIZE
                if block is not None and base <= at and at + size <= base + len(block):
                    image = block[at - base : at - base + size]
                else:
                    image = self._again(archive, at, size)
                return key, n_bytes, image, from_image(image)
            except (ValueError, zlib.error):
                block = None
                if k + 1 == self.tries:
                    raise
        raise OSError("unreachable")

    def read(self, partition: ByteRange):
        if not partition.size:
            return
        (count,) = struct.unpack("<q", self._again(partition.archive, partition.size - 8, 8))
        table = self._again(partition.archive, partition.size - 8 - 8 * count, 8 * count) if count else b""
        offsets = np.frombuffer(table, "<i8")
        mine = offsets[(offsets >= partition.start) & (offsets < partition.end)].tolist()
        data_end = partition.size - 8 - 8 * count
        rows, held, block, base = [], 0, None, 0
        for offset in mine:
            if block is None or offset + _HEAD_SIZE > base + len(block):
                base = offset
                block = self._again(partition.archive, base, min(BLOCK, data_end - base))
            rows.append(self._member(partition.archive, offset, block, base))
            held += len(rows[-1][3])
            if held >= BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        ids, sizes, images, samples = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == -(2**63) else i for i in ids], pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(images, pa.binary()), pa.array(samples, pa.binary()),
            ],
            ["doc_id", "n_bytes", "media", "samples"],
        )


class ArchiveSource(DataSource):
    """``spark.read.format("member_archive").load(folder)``: doc_id, n_bytes, media, samples."""

    @classmethod
    def name(cls):
        return "member_archive"

    def schema(self):
        return "doc_id long, n_bytes long, media binary, samples binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


def _features(batches):
    """A text's feature: mean and spread of its samples, mean step between neighbours, and the
    shares of the eight ranges of 32 levels."""
    for batch in batches:
        col = batch.column(1)
        out = []
        for i in range(len(col)):
            x = np.frombuffer(col[i].as_buffer(), np.uint8)
            levels = np.bincount(x >> 5, minlength=8) / len(x)
            count = np.bincount(x, minlength=256)
            mean = float(count @ np.arange(256)) / len(x)
            spread = (float(count @ (np.arange(256) - mean) ** 2) / len(x)) ** 0.5
            step = float(np.abs(np.diff(x.view(np.int8).astype(np.int16))).mean())
            out.append(" ".join(f"{v:.4f}" for v in (mean, spread, step, *levels)))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4, 5, 6, 7)), pa.array(out)], _OUT)


_OUT = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_features(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, digests and features of the stored bytes, read back through the data source."""
    spark.dataSource.register(ArchiveSource)
    media = spark.read.format("member_archive").load(folder)
    rows = media.select(
        "doc_id", "samples", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(samples, -{ROW}, {ROW})")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
    )
    return rows.mapInArrow(
        _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = S.new_folder(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return media_features(spark, folder)


QUERIES = {"op3_media_columns": op3_media_columns}
ORACLES: dict[str, str] = {}
