"""Media columns: archives of media members as a Spark data source.

Writing: each task stores its rows in one ZIP archive of the shared folder. A
member is a mono 8-bit PCM WAV file whose samples are the row's payload bytes. An archive is written
under another name and renamed when complete, named after its partition, so a retried task
replaces its own archive and leaves no others.

Reading: the data source `quill_archives` plans byte ranges over the archives from
their sizes alone. A task reads the directory at the archive's end, takes the members
whose offset lies in its range, and streams them as Arrow batches bounded in bytes. A
member that can't be read or fails its checksum is tried again by itself from its offset;
after the last try it comes out as a row with `error` set and no payload.

Null texts are empty; payloads are zero-padded to a positive multiple of 64 bytes. Repeated rows are
members of their own. An empty table writes no archive and reads as no rows.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch

UNIT, HEADER = 64, 44
SCHEMA = "archive string, offset bigint, name string, media binary, error string"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows: file, hdfs, s3, gs."""
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A RIFF file of 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    size, = struct.unpack("<I", media[40:HEADER])
    if media[:4] != b"RIFF" or media[36:40] != b"data" or len(media) != HEADER + size:
        raise ValueError("not an 8-bit WAV file of this writer")
    return media[HEADER:]


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """Writes the rows; returns (archive, members, bytes) of the archives. Run it once, by an action."""

    def run(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        final, temporary = f"{root}/part-{part:06d}.zip", f"{root}/.{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(temporary) as raw, zipfile.ZipFile(_Counted(raw), "w", zipfile.ZIP_DEFLATED, compresslevel=level) as out:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                for key, text in zip(ids, texts):
                    info = zipfile.ZipInfo(json.dumps([n, key, len(text or b"")]))
                    info.compress_type = zipfile.ZIP_DEFLATED
                    out.writestr(info, wav(payload_of(text)))
                    n += 1
        if n:
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pylist([{"archive": final, "members": n, "bytes": fs.get_file_info(final).size}])
        else:
            fs.delete_file(temporary)

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "archive string, members bigint, bytes bigint")


class _Counted(io.RawIOBase):
    """A forward-only stream that knows its place, as zipfile asks of a file it can't seek in."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def writable(self):
        return True

    def write(self, data):
        self.raw.write(data)
        self.at += len(data)
        return len(data)

    def tell(self):
        return self.at

    def flush(self):
        pass


class Range(InputPartition):
    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


class ArchiveSource(DataSource):
    """Options: path, range_bytes (planned partition), batch_bytes (most in an Arrow batch), tries."""

    @classmethod
    def name(cls) -> str:
        return "quill_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range, self.batch, self.tries = (int(options.get(k, d)) for k, d in (("range_bytes", 8 << 20), ("batch_bytes", 8 << 20), ("tries", 3)))

    def partitions(self) -> list[Range]:
        fs, root = filesystem(self.path)
        files = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".zip")]
        cuts = [(f.path, f.size, s) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.range)]
        return [Range(p, n, s, s + self.range) for p, n, s in cuts] or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        if not part.archive:
            return
        fs, _ = filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(part.archive) as file:
            for name, offset, size, raw, crc, method in directory(file, part.size):
                if part.start <= offset < part.end:
                    media, error = self.member(fs, part.archive, file, offset, size, crc, method)
                    rows.append((part.archive, offset, name, media, error))
                    held += raw
                    if held >= self.batch or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def member(self, fs, archive, file, offset, size, crc, method) -> tuple[bytes | None, str | None]:
        """One member, read again from its offset, over a new handle, up to `tries` times."""
        error = None
        for attempt in range(self.tries):
            try:
                if attempt == 0:
                    return fetch(file, offset, size, crc, method), None
                with fs.open_input_file(archive) as again:
                    return fetch(again, offset, size, crc, method), None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error


def directory(file, size: int):
    """(name, offset, stored size, size, checksum, method) of each member, from the archive's end."""

    class Tail(io.RawIOBase):
        at = 0

        def seek(self, n, how=0):
            self.at = n + (0, self.at, size)[how]
            return self.at

        def tell(self):
            return self.at

        def seekable(self):
            return True

        def read(self, n=-1):
            n = size - self.at if n is None or n < 0 else min(n, size - self.at)
            got = file.read_at(n, self.at)
            self.at += len(got)
            return got

    for info in zipfile.ZipFile(Tail()).infolist():
        yield info.filename, info.header_offset, info.compress_size, info.file_size, info.CRC, info.compress_type


def fetch(file, offset: int, size: int, crc: int, method: int) -> bytes:
    head = file.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    names, extra = struct.unpack("<HH", head[26:30])
    data = file.read_at(size, offset + 30 + names + extra)
    data = zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
    if zlib.crc32(data) != crc:
        raise ValueError(f"checksum of the member at {offset}")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["archive", "offset", "name", "media", "error"])


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """(archive, offset, name, media, error) of every member."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("quill_archives").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def feature(data: np.ndarray) -> str:
    """Sample statistics as text: count, extremes, sum, energy about the middle, zero crossings, peak bin of a coarse histogram."""
    x = data.astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    bins = np.bincount(data >> 4, minlength=16)
    return f"n={len(x)};min={int(x.min())};max={int(x.max())};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns};peak={int(bins.argmax())}"


def features(members: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error) of each member, from the bytes read back."""
    import hashlib

    kinds = {"doc_id": pa.string(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}

    def run(batches):
        for batch in batches:
            rows = []
            for name, media, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                _, key, n = json.loads(name)
                row = dict.fromkeys(kinds) | {"doc_id": key, "n_bytes": n, "error": error}
                if media.is_valid:
                    media = media.as_py()
                    data = samples(media)
                    row |= {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-UNIT:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(np.frombuffer(data, np.uint8))}
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return members.select("name", "media", "error").mapInArrow(run, "doc_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media, reads it back and computes the features; an unreadable member fails the query."""
    scratch = Scratch(docs.sparkSession, "media")
    folder = f"{scratch.path}/archives"
    scratch.save(write_archives(docs, folder, id_col, text_col), "manifest")
    kind = docs.schema[id_col].dataType.simpleString()
    members = read_archives(docs.sparkSession, folder)
    out = features(members).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_col)
    bad = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("unreadable member: "), F.col("error"))).cast("string")).otherwise(F.col("feature"))
    return scratch.keep(out.withColumn("feature", bad).drop("error"))
