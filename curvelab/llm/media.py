"""Media columns: a Spark data source for archives of media members.

``media_archive`` is a custom data source, for writing and reading. A write
task streams its rows' media into ZIP archives in the shared folder; the commit
lists the archives of the attempts that counted in a manifest of its own, so that what a
lost executor left behind is never read; appending adds a manifest, overwriting removes
the earlier ones and what they list. Reading plans byte ranges of the
archives from their sizes alone; a task reads the archive's directory (at its
end), takes the members that start in its range, reads each by its offset,
retries each on its own, and streams batches through Arrow. A member that stays
unreadable is a row with ``error`` for whoever reads the source; the query fails on it,
as it promises every payload.

The query stores every text as samples of an 8-bit grey PNG image, 64 wide. It
is padded with zero bytes to whole rows, one row at least.

Defined results: a null text is the empty one; repeated rows are members each;
a null doc_id is kept; an empty table gives an empty archive and no rows; other
columns are not read. Texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from curvelab.llm.common import new_path

FORMAT, WIDTH, LEVEL = "media_archive", 64, 1
#: Bytes at which a new archive begins, that a read task takes, and of a batch.
ARCHIVE, RANGE, BATCH = 64 << 20, 8 << 20, 4 << 20
RETRIES, PAUSE_S = 3, 0.2
#: Read tasks that are planned at most; ranges grow beyond RANGE with the archives.
TASKS = 100_000
MANIFEST = "_manifest-"
MEMBERS = "archive string, member_offset long, name string, media binary, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH wide, of the payload's samples; unfiltered rows."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image with unfiltered rows; checksums are verified."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, share of edges along rows, and a 64-bit average hash of an image."""
    n, x = samples.size, samples.astype(np.int64)
    mean, square = int(x.sum()) / n, int((x * x).sum()) / n
    edges = int((np.abs(np.diff(x, axis=1)) > 32).sum()) / max(1, x.shape[0] * (x.shape[1] - 1))
    h, w = x.shape
    cuts = np.arange(8) * h // 8
    sums = np.add.reduceat(np.add.reduceat(x, cuts, axis=0), np.arange(8) * w // 8, axis=1)
    cells = sums * 8 > (x.sum() * np.maximum(np.diff(np.append(cuts, h)), 1)[:, None] * (w // 8)) * 8 // n
    return f"mean={mean:.4f};std={max(0.0, square - mean * mean) ** 0.5:.4f};edges={edges:.4f};ahash={np.packbits(cells.ravel()).tobytes().hex()}"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass
class _Written(WriterCommitMessage):
    archives: list = field(default_factory=list)


def _manifests(store: pafs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST))


def _listed(store: pafs.FileSystem, manifest: str) -> list:
    with store.open_input_stream(manifest) as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, limit: int, overwrite: bool):
        self.path, self.limit, self.overwrite = path, limit, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        out, sink, archive, name, n = _Written(), None, None, "", 0

        def close() -> None:
            archive.close()
            out.archives.append((name, sink.tell()))
            sink.close()

        for batch in iterator:
            for key, media in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    sink = store.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{key.as_py()}-{n}"), media.as_py())
                n += 1
                if sink.tell() >= self.limit:
                    close()
                    archive = None
        if archive is not None:
            close()
        return out

    def commit(self, messages: list) -> None:
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        before = _manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        for old in before:
            archives = _listed(store, old)
            store.delete_file(old)
            for name, _ in archives:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        pass  # nothing counts without a manifest


def read_member(open_archive: Callable, info: zipfile.ZipInfo, retries: int = RETRIES, pause: float = PAUSE_S) -> tuple[bytes | None, str | None]:
    """(bytes, None), or (None, error) after so many attempts, each on a newly opened archive after the first."""
    error = "no attempt"
    for attempt in range(retries):
        try:
            f = open_archive(attempt > 0)
            f.seek(info.header_offset)
            head = f.read(30)
            name, extra = struct.unpack("<HH", head[26:30])
            f.seek(info.header_offset + 30 + name + extra)
            data = f.read(info.compress_size)
            if head[:4] != b"PK\x03\x04" or len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                raise OSError("the member's bytes are not those of the directory")
            return data, None
        except (OSError, struct.error) as e:
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < retries:
                time.sleep(pause * 2**attempt)
    return None, error


class _Reader(DataSourceReader):
    def __init__(self, path: str, span: int, batch: int, retries: int):
        self.path, self.span, self.batch, self.retries = path, span, batch, retries

    def partitions(self) -> list[InputPartition]:
        store, root = _filesystem(self.path)
        manifests = _manifests(store, root)
        if not manifests:
            raise FileNotFoundError(f"{self.path} has no manifest")
        archives = [a for m in manifests for a in _listed(store, m)]
        span = max(self.span, -(-sum(size for _, size in archives) // TASKS))
        return [InputPartition((name, at, at + span)) for name, size in archives for at in range(0, size, span)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member_offset", pa.int64()), ("name", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        if partition.value is None:
            yield pa.RecordBatch.from_pylist([], schema=schema)
            return
        name, start, end = partition.value
        store, root = _filesystem(self.path)
        handle = [store.open_input_file(f"{root}/{name}")]

        def open_archive(again: bool):
            if again:
                handle[0] = store.open_input_file(f"{root}/{name}")
            return handle[0]

        members = [i for i in zipfile.ZipFile(handle[0]).infolist() if start <= i.header_offset < end]
        rows, held = [], 0
        for info in members:
            data, error = read_member(open_archive, info, self.retries)
            rows.append((name, info.header_offset, info.filename, data, error))
            held += len(data or b"")
            if held >= self.batch:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


class MediaArchive(DataSource):
    """Options: path; archive_bytes, range_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBERS

    def _number(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self._number("archive_bytes", ARCHIVE), overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._number("range_bytes", RANGE), self._number("batch_bytes", BATCH), self._number("retries", RETRIES))


def images(docs: DataFrame) -> DataFrame:
    """(name, media) of each row's text; the name carries doc_id and the unpadded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, media = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = text.as_py() or b""
                names.append(f"{'null' if doc_id is None else doc_id}_{len(data)}")
                media.append(encode_png(padded(data)))
                if sum(map(len, media[-256:])) > BATCH:
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["name", "media"])
                    names, media = [], []
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["name", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "name string, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(members: DataFrame, strict: bool = False) -> DataFrame:
    """A row of measures per member that was read; only ``error`` and what the name says where it was not, or with ``strict`` a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in FEATURES.split(", ")]
        for b in batches:
            rows = []
            for name, media, error in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                doc_id, n_bytes = name.rpartition("-")[0].rsplit("_", 1)
                row = [None if doc_id == "null" else int(doc_id), int(n_bytes)]
                if error is not None:
                    if strict:
                        raise OSError(f"{name}: {error}")
                    rows.append([*row, *[None] * 6, error])
                    continue
                data = media.as_py()
                samples = decode_png(data)
                payload = samples.tobytes()
                rows.append([*row, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples), None])
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    return members.select("name", "media", "error").mapInArrow(run, FEATURES)


def stored_features(docs: DataFrame, **options: int) -> DataFrame:
    """Write every text as an image into archives in the shared folder, read them back, measure them."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    path = new_path(spark, "media")
    images(docs).write.format(FORMAT).mode("append").options(path=path, **options).save()
    return features(spark.read.format(FORMAT).options(path=path, **options).load(), strict=True)
