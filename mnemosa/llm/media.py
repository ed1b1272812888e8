"""Media columns: content-addressed images in tar shards, with rows of digest, offset and length.

A payload is stored as an 8-bit greyscale PNG of 576 pixels a row, which keeps
every sample; the count of bytes before padding is a text entry ahead of the
samples.  Each task writes the images of its rows to tar shards of its own in the
shared folder, each image once a shard, under a temporary name that becomes the
final one when the shard is whole: a task that is lost or runs twice leaves the
same shard.  Rows then agree on one place for each digest, so that equal
payloads are read once, wherever copies were written.

Metadata columns come from reads of the first HEAD bytes of an image only;
features from a read of the whole.

Defined cases: null text counts as empty; an empty payload is one row of padding;
repeated rows share a place; an empty table writes no shard and gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, fresh
from .textkit import flat

WIDTH, PAD, HEAD, SHARD, TAIL = 576, 255, 128, 1 << 27, 32
#: Bytes of images for a reading task.
TASK = 1 << 24
_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload_of(text: bytes) -> bytes:
    """The text padded to a positive multiple of WIDTH."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def encode_png(payload: bytes, unpadded: int) -> bytes:
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"Source-Bytes\0%d" % unpadded)
    return head + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def read_head(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and bytes before padding, from the first HEAD bytes."""
    if head[:8] != _MAGIC:
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    size = struct.unpack(">I", head[33:37])[0]
    return width, height, bits, int(head[41 : 41 + size].split(b"\0")[1])


def decode_png(data: bytes) -> bytes:
    """All samples; every chunk's checksum is verified."""
    at, found = 8, []
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            found.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(found)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy in thousandths, and a hash of 64 bits: which of 64 equal parts are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    used = share[share > 0]
    parts = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = int("".join("1" if b else "0" for b in parts > x.mean()), 2)
    return f"{x.mean() * 1000:.0f}:{x.std() * 1000:.0f}:{-(used * np.log2(used)).sum() * 1000:.0f}:{bits:016x}"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://"))


class Shards:
    """Writes one task's tar shards."""

    def __init__(self, folder: str, task: int, most: int = SHARD):
        self.fs, self.root = _open(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.task, self.most, self.number, self.out = task, most, 0, None

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        """The shard and the offset of the data in it; the same digest has one place in a shard."""
        if self.out is not None and digest in self.places:
            return self.name, self.places[digest]
        if self.out is not None and self.at + len(data) > self.most:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.task:06d}-{self.number:04d}-{digest[:16]}.tar"
            self.part = f"{self.root}/.{self.name}-{uuid.uuid4().hex}"
            self.out, self.at, self.places, self.number = self.fs.open_output_stream(self.part), 0, {}, self.number + 1
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.places[digest] = self.at + len(head)
        fill = -len(data) % 512
        self.out.write(head + data + bytes(fill))
        self.at += len(head) + len(data) + fill
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.fs.move(self.part, f"{self.root}/{self.name}")
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, digest, shard, offset, length of each row; the shards are written when this is computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shards = Shards(folder, TaskContext.get().partitionId())
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            data, at, out = data.tobytes(), offsets.tolist(), []
            for a, b in zip(at[:-1], at[1:], strict=True):
                image = encode_png(payload_of(data[a:b]), b - a)
                digest = hashlib.sha256(image).hexdigest()
                out.append((digest, *shards.add(digest, image), len(image)))
            digest, shard, place, length = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(place, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "digest", "shard", "offset", "length"])
        shards.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest string, shard string, offset long, length long")


def places(stored: DataFrame) -> DataFrame:
    """One place of each digest."""
    one = F.min(F.struct("shard", "offset", "length")).alias("at")
    return stored.groupBy("digest").agg(one).select("digest", "at.*")


def with_metadata(media: DataFrame, folder: str, whole: bool = True, tasks: int | None = None) -> DataFrame:
    """digest and the metadata columns from header-only reads; with `whole`, also what a read of the whole image gives.

    tasks: how many to deal the reads to; rows are few bytes, so their own size says little of the work.
    """
    names = ["digest", "width", "height", "bits", "n_bytes", *["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] * whole]
    schema = "digest string, width int, height int, bits int, n_bytes long" + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{root}/{shard}")
                row = [digest, *read_head(file.read_at(min(HEAD, length), offset))]
                if whole:
                    image = file.read_at(length, offset)
                    payload, sha = decode_png(image), hashlib.sha256(image).hexdigest()
                    if sha != digest:
                        raise ValueError(f"{shard} at {offset} doesn't hold {digest}")
                    row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(image), sha, feature(payload)]
                out.append(row)
            if out:
                types = pa.schema([("digest", pa.string()), *((c, pa.int32()) for c in ("width", "height", "bits")), ("n_bytes", pa.int64()), *[("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())] * whole])
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], names)

    place = ["shard", F.floor(F.col("offset") / (1 << 20))]
    dealt = (media.repartition(tasks, *place) if tasks else media.repartition(*place)).sortWithinPartitions("shard", "offset")
    return dealt.mapInArrow(run, schema)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Each row of docs with its digest, place and metadata and features read back from the shards in `folder` (a fresh shared one)."""
    spark = docs.sparkSession
    folder = folder or fresh(spark, "media")
    stored = Tables(spark).write("media-rows", store(docs, folder))
    one, stored_bytes = places(stored), stored.agg(F.sum("length")).first()[0] or 0
    read = with_metadata(one, folder, tasks=1 + stored_bytes // TASK).join(one, "digest")
    return stored.select("doc_id", "digest").join(read, "digest")
