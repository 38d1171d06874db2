"""Token ids in Arrow stream files: fixed-size lists of ids and masks, one sequence after the other.

Documents are range-partitioned and sorted by id; each partition writes one
file. Its ids run on from document to document, cut into sequences of equal
length; the last is filled up, the mask says which ids are real. Batches hold
a fixed number of sequences, so the place of id k is a division away, and a
mapped file gives ids without a copy. A second file has each document's place.
Files are written beside their final name and moved there, so a task that runs
twice leaves one file; with the partitions' totals a file's ids have a global
place as well.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import documents, new_path, written
from waywarden.llm.tokens import chunks, encoder, path

LENGTH = 1024
PER_BATCH = 256
FILES_A_TASK = 8
END = 0
FILE = "byte_bpe_50k.json"

PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder on this machine: a plain path or file: is the shared mount."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def sequences(length: int, dtype: str) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """A stream file of sequences that is filled id by id."""

    def __init__(self, sink, length: int, dtype: str):
        self.schema, self.length, self.dtype = sequences(length, dtype), length, dtype
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0
        self.block = length * PER_BATCH * np.dtype(dtype).itemsize

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            data = b"".join(self.parts)
            for at in range(0, len(data) - self.block + 1, self.block):
                self._write(np.frombuffer(data, self.dtype, self.length * PER_BATCH, at), self.length * PER_BATCH)
            rest = data[len(data) // self.block * self.block :]
            self.parts, self.held = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), self.length) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(ids):
            full = -(-len(ids) // self.length) * self.length
            self._write(np.concatenate([ids, np.zeros(full - len(ids), self.dtype)]), len(ids))
        self.out.close()


def _write(folder: str, file: str, length: int, end: int):
    def run(batches):
        enc, task = encoder(file), TaskContext.get()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, tail = task.partitionId(), np.array([end], dtype=enc.dtype).tobytes()
        name, mine = f"part-{part:06d}", f"{base}/.attempt-{task.taskAttemptId()}"
        total = docs = 0
        with fs.open_output_stream(mine + ".arrow") as data, fs.open_output_stream(mine + ".index.arrow") as index:
            out, places = _Writer(data, length, enc.dtype), pa.ipc.new_stream(index, PLACES)
            for b in batches:
                ids_of = b.column("doc_id")
                for at, texts in chunks(b):
                    starts, counts = [], []
                    for ids in enc.encode(texts):
                        out.add(ids + tail)
                        starts.append(total)
                        counts.append(len(ids) // len(tail) + 1)
                        total += counts[-1]
                    docs += len(texts)
                    places.write_batch(pa.RecordBatch.from_arrays([ids_of.slice(at, len(texts)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=PLACES))
            out.close()
            places.close()
        for suffix in (".arrow", ".index.arrow"):
            fs.move(mine + suffix, f"{base}/{name}{suffix}")
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["part", "name", "n_docs", "n_tokens"])

    return run


def write_files(df: DataFrame, folder: str, file: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Writes df's texts in ascending doc_id order; the manifest (part, name, n_docs, n_tokens, base), one row a file.

    Null texts are empty; each document ends with the end id. A null id comes
    first, rows of one id follow each other by text. No rows give no files.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = order.mapInArrow(_write(folder, file or path(FILE), length, end), "part long, name string, n_docs long, n_tokens long")
    # summed before it is written: the manifest is one small file, and tasks that encode write no table (on file: Hadoop starts a chmod for each file)
    return written(files.withColumn("base", F.expr("coalesce(sum(n_tokens) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")), "manifest")


class Sequences:
    """A written stream file as an array of equal-length sequences: any of them is one division and one look away.

    All batches but the last hold the same number of sequences and take the
    same number of bytes, so batch b stands at first + b * step. A local file is
    mapped and ids are views of it, no copy is made; of a remote one only the
    batch that is asked for is read.
    """

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.size, self.held = self.file.size(), (-1, None, None)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.file))
        self.length, self.first = self.schema.field("ids").type.list_size, self.file.tell()
        self.step, self.per = 0, 1
        try:
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        except EOFError:  # no sequence was written
            return
        self.step, self.per = self.file.tell() - self.first, batch.num_rows

    def batch(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and masks of a batch, one sequence a row."""
        if self.held[0] != b:
            at = self.first + b * self.step
            if b < 0 or not self.step or at >= self.size:
                raise IndexError(f"no batch {b}")
            self.file.seek(at)
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(pa.py_buffer(self.file.read_buffer(min(self.step, self.size - at)))), self.schema)
            ids, mask = (batch[c].flatten() for c in ("ids", "mask"))
            self.held = (b, ids.to_numpy().reshape(-1, self.length), mask)
        return self.held[1], self.held[2]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i."""
        ids, mask = self.batch(i // self.per)
        row = i % self.per
        if row >= len(ids):
            raise IndexError(f"no sequence {i}")
        return ids[row], mask.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start on: a view where one batch has them all."""
        parts, per = [], self.per * self.length
        while n:
            ids = self.batch(start // per)[0].reshape(-1)[start % per : start % per + n]
            if not len(ids):
                raise IndexError(f"no id {start}")
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _read(folder: str, digest: bool):
    def run(batches):
        fs, base = open_fs(folder)
        local = isinstance(fs, pafs.LocalFileSystem)

        for b in batches:
            for name, first in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                sequences_ = Sequences(fs, f"{base}/{name}.arrow")
                index = f"{base}/{name}.index.arrow"
                for places in pa.ipc.open_stream(pa.memory_map(index) if local else fs.open_input_stream(index)):
                    out = []
                    for start, n in zip(places["start"].to_pylist(), places["n_tokens"].to_pylist(), strict=True):
                        ids = sequences_.ids(start, n).astype("<u4").tobytes()
                        out.append(zlib.crc32(ids) if digest else ids)
                    yield pa.RecordBatch.from_arrays(
                        [places["doc_id"], pa.array(places["start"].to_numpy() + first), places["n_tokens"], pa.array(out, pa.int64() if digest else pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                    )

    return run


def read_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files, ids as little-endian 32-bit; with digest their checksum in place of them."""
    last = "ids_crc32 long" if digest else "ids binary"
    names, n = manifest.select("name", F.col("base").cast("long").alias("base")), manifest.count()
    # dealt out in turn: as many to each task, all cores busy, and no table of tiny parts
    tasks = max(1, min(n, manifest.sparkSession.sparkContext.defaultParallelism), -(-n // FILES_A_TASK))
    return names.repartition(tasks).mapInArrow(_read(folder, digest), f"doc_id long, start long, n_tokens long, {last}")


def op4(spark, sf_dir):
    folder = new_path(spark, "tokens")
    manifest = write_files(documents(spark, sf_dir), folder)
    return read_files(manifest, folder, digest=True)
