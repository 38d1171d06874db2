"""Bounded-space online packing of documents into token windows.

Each partition keeps a fixed number of open windows. A document longer than a
window fills whole ones and leaves a rest; a rest goes into the open window
with the least room that holds it (best fit); when none fits, the fullest is
emitted and a new one opened. At the end of a partition its open windows are
leftovers. Leftovers of up to MERGE partitions are packed together, as a
whole, by the same rule from the longest down; only these few rows move.

Window ids are (partition, number) pairs in one long, so no global count is
needed. A window's length is the smallest power of two that holds it, WINDOW
at most.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import documents, written
from waywarden.llm.tokens import chunks, encoder, path

WINDOW = 4096
END = 2
OPEN = 64
MERGE = 32
FILE = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, window long, offset long, open boolean"


class Windows:
    """Open windows as a sorted list of (room, number)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.next = 0

    def put(self, length: int, item) -> list:
        """Places an item; what a window emitted for it held, in order, else nothing."""
        out = []
        at = bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):
            if len(self.rooms) >= self.most:
                _, full = self.rooms.pop(0)
                out = [(full, self.held.pop(full))]
            room, number = self.size, self.next
            self.next += 1
            self.held[number] = []
        else:
            room, number = self.rooms.pop(at)
        self.held[number].append((self.size - room, length, item))
        if room == length:
            out.append((number, self.held.pop(number)))
        else:
            insort(self.rooms, (room - length, number))
        return out


def _pack(file: str, window: int, end: int, most: int, with_ids: bool):
    def run(batches):
        enc, part, open_ = encoder(file), TaskContext.get().partitionId(), Windows(window, most)
        tail = np.array([end], dtype="<u4").tobytes()
        rows: list[tuple] = []

        def give(number, held, is_open):
            for offset, length, (doc, start, crc, total, ids) in held:
                rows.append((doc, start, length, crc, total, ids, (part << 32) | number, offset, is_open))

        def batch():
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 2 + [pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])
            rows.clear()
            return out

        for b in batches:
            docs = b.column("doc_id").to_pylist()
            for at, texts in chunks(b):
                for i, ids in enumerate(enc.encode(texts)):
                    whole = np.frombuffer(ids, enc.dtype).astype("<u4").tobytes() + tail
                    total = len(whole) // 4
                    for start in range(0, total, window):
                        piece = whole[4 * start : 4 * (start + window)]
                        item = (docs[at + i], start, zlib.crc32(piece), total, piece if with_ids else None)
                        for number, held in open_.put(len(piece) // 4, item):
                            give(number, held, False)
                if rows:
                    yield batch()
        for number, held in sorted(open_.held.items()):
            give(number, held, True)
        if rows:
            yield batch()

    return run


def _merge(window: int):
    def run(key, table: pa.Table):
        rows = table.sort_by([("window", "ascending"), ("offset", "ascending")]).to_pylist()
        groups: dict[int, list[dict]] = {}
        for r in rows:
            groups.setdefault(r["window"], []).append(r)
        sized = sorted(groups.items(), key=lambda g: (-sum(r["length"] for r in g[1]), g[0]))
        windows, out = Windows(window, len(sized) + 1), []

        def give(held):
            first = held[0][2][0]["window"]
            for offset, _, group in held:
                for r in group:
                    out.append(r | {"window": first, "offset": offset + r["offset"], "open": False})

        for _, group in sized:
            for _, held in windows.put(sum(r["length"] for r in group), group):
                give(held)
        for held in windows.held.values():
            give(held)
        return pa.Table.from_pylist(out, schema=table.schema)

    return run


def pack(df: DataFrame, file: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece of each row of df, see PIECES (without open); ids as little-endian 32-bit, null unless with_ids.

    Each row is a document of its own, also where ids repeat or are null. Null
    and empty texts have one id, the end. An empty table gives no rows.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(rows.mapInArrow(_pack(file or path(FILE), window, end, OPEN, with_ids), PIECES), "pieces")
    left = first.filter("open").withColumn("_group", F.expr(f"shiftright(window, 32) div {MERGE}"))
    merged = left.groupBy("_group").applyInArrow(lambda key, t: _merge(window)(key, t.select([f.split()[0] for f in PIECES.split(", ")])), PIECES)
    out = first.filter("NOT open").unionByName(merged)
    return out.drop("open")


def windows(pieces: DataFrame) -> DataFrame:
    """One row for each window of pieces with ids: its ids in order, used, and its padded length."""
    by = pieces.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("p"))
    used = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    padded = F.pow(F.lit(2), F.ceil(F.log2(F.col("used")))).cast("long")
    # a binary's join: hex text would double it, concat over the array keeps bytes
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return by.select("window", ids.alias("ids"), used.alias("used")).withColumn("padded", padded)


def op9(spark, sf_dir):
    pieces = pack(documents(spark, sf_dir), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset")
