import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import table, texts
from waywarden.llm import packing, token_files, tokens
from waywarden.llm.common import new_path, written

ODD = ["İstanbul'S foo’s", "a  b\n\n c\t d ", "²³½ x", "é café", "it's DON'T 'll", "　wide space", "x<|endoftext|>y z", "ΣΑΣ ς", "日本語 テスト", "\x1c\x1d a", "ß ẞ Ǆ", "'", " '", "  ", "\n", "a" * 5000, "", "don''t ''s", "_x_ __", "1234 56", "\x85a"]


@pytest.mark.parametrize("file", [token_files.FILE, packing.FILE])
def test_pieces_encode_as_whole_texts(file):
    from tokenizers import Tokenizer

    enc, whole = tokens.Encoder(tokens.path(file)), Tokenizer.from_file(tokens.path(file))
    rows = [*ODD, *[t for t in texts() if t]]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(rows)] == [whole.encode(t, add_special_tokens=False).ids for t in rows]


def reference(file, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.path(file))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in rows]


def test_files_round_trip(spark):
    rows = texts()
    folder = new_path(spark, "t")
    manifest = token_files.write_files(table(spark, rows, extra=True).repartition(3), folder)
    out = {(r["doc_id"], r["start"]): r for r in token_files.read_files(manifest, folder).collect()}
    ids = reference(token_files.FILE, rows, 0)
    order = sorted(range(len(rows)), key=lambda i: (i != 4, i))  # the null id comes first
    at = 0
    for i in order:
        r = out[(None if i == 4 else i, at)]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[i] and r["n_tokens"] == len(ids[i])
        at += len(ids[i])
    # any file opens as a stream of equal sequences whose mask counts the ids
    real = 0
    for f in Path(folder).glob("part-??????.arrow"):
        for b in pa.ipc.open_stream(pa.memory_map(str(f))):
            assert b["ids"].type == pa.list_(pa.uint16(), token_files.LENGTH)
            real += b["mask"].flatten().true_count
    assert real == at


def test_any_sequence_is_a_division_away(spark):
    """Batches of 256 sequences and a last short one: all looks give what a walk through the stream gives."""
    rows = [" ".join(f"word{i} {j}" for j in range(700)) for i in range(220)] + ["short", None]
    folder = new_path(spark, "t")
    token_files.write_files(table(spark, rows).coalesce(1), folder, length=64).collect()
    f, = Path(folder).glob("part-??????.arrow")
    fs, name = token_files.open_fs(str(f))
    s = token_files.Sequences(fs, name)
    walked = [(b["ids"][i].values.to_numpy(), b["mask"][i].values.to_numpy(zero_copy_only=False)) for b in pa.ipc.open_stream(pa.memory_map(str(f))) for i in range(len(b))]
    assert len(walked) > 3 * token_files.PER_BATCH and s.per == token_files.PER_BATCH
    for i in [0, 1, 255, 256, 511, len(walked) - 1, *np.random.default_rng(1).integers(0, len(walked), 50).tolist()]:
        ids, mask = s[i]
        assert (ids == walked[i][0]).all() and (mask == walked[i][1]).all()
    # a view of the mapped file, not a copy
    assert not s[300][0].flags.owndata and not s[300][0].flags.writeable
    whole = np.concatenate([w[0] for w in walked])
    for start, n in ((0, 5), (64 * 256 - 3, 9), (1000, 40_000), (len(whole) - 2, 2)):
        assert (s.ids(start, n) == whole[start : start + n]).all()
    for bad in (len(walked), -1, 10**9):
        with pytest.raises(IndexError):
            s[bad]


def test_entry_gives_checksums_of_the_ids(spark, tmp_path):
    rows = texts()
    df = table(spark, [*rows, *rows[:2]])
    repeated = df.unionByName(df.filter("doc_id = 3"))
    repeated.write.parquet(f"{tmp_path}/documents.parquet")
    ids = reference(token_files.FILE, [*rows, *rows[:2]], 0)
    want, at = [], 0
    for i in sorted([*range(len(ids)), 3], key=lambda i: (i != 4, i)):
        raw = np.array(ids[i], "<u4").tobytes()
        want.append((None if i == 4 else i, at, len(ids[i]), zlib.crc32(raw)))
        at += len(ids[i])
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op4(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_the_manifest_is_one_file(spark):
    """However many tasks encode, none writes a part of the manifest; bases run on from file to file."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        manifest = token_files.write_files(table(spark).repartition(3), new_path(spark, "t"))
    finally:
        spark.conf.set(key, before)
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    assert len(rows) > 1 and [r["base"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]
    assert len(manifest.inputFiles()) == 1


def test_files_are_dealt_out_evenly(spark):
    """Files go to tasks in equal shares: as many tasks as cores, more where a task would have more than eight."""
    folder, names = new_path(spark, "t"), [f"part-{i:06d}" for i in range(43)]
    Path(folder).mkdir(parents=True)
    for i, name in enumerate(names):
        with open(f"{folder}/{name}.arrow", "wb") as data, pa.ipc.new_stream(f"{folder}/{name}.index.arrow", token_files.PLACES) as places:
            w = token_files._Writer(data, 8, "<u2")
            w.add(np.array([i, 0], "<u2").tobytes())
            w.close()
            places.write_batch(pa.record_batch([[i], [0], [2]], schema=token_files.PLACES))
    manifest = written(spark.createDataFrame([(name, 2 * i) for i, name in enumerate(names)], "name string, base long").coalesce(1), "manifest")
    out = token_files.read_files(manifest, folder).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == [(i, 2 * i, 2, [i, 0]) for i in range(43)]
    shares = Counter(r["task"] for r in out).values()
    assert len(shares) == max(spark.sparkContext.defaultParallelism, 6) and max(shares) - min(shares) <= 1


def test_no_rows_give_no_files(spark):
    folder = new_path(spark, "t")
    assert token_files.read_files(token_files.write_files(table(spark, []), folder), folder).count() == 0


@pytest.mark.parametrize("window", [64, 4096])
def test_packing_keeps_every_id_once(spark, window):
    rows = texts()
    ids = reference(packing.FILE, rows, 2)
    p = packing.pack(table(spark, rows, extra=True).repartition(4), window=window).toPandas()
    for key, g in p.groupby("doc_id", dropna=False):
        g = g.sort_values("start")
        whole = ids[4 if np.isnan(key) else int(key)]
        assert np.concatenate([np.frombuffer(x, "<u4") for x in g.ids]).tolist() == whole and (g.doc_tokens == len(whole)).all()
        assert (g.ids_crc32 == [zlib.crc32(x) for x in g.ids]).all()
    for _, g in p.groupby("window"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= window


def test_windows_join_their_pieces(spark):
    p = packing.pack(table(spark), window=256)
    w = packing.windows(p).toPandas()
    assert (w.ids.map(len) == 4 * w.used).all() and (w.padded >= w.used).all() and w.padded.map(lambda n: n & (n - 1) == 0).all()


def test_best_fit_in_bounded_space():
    w = packing.Windows(10, 2)
    assert w.put(6, "a") == [] and w.put(5, "b") == []
    assert [i for _, held in w.put(5, "c") for _, _, i in held] == ["b", "c"]  # the tightest that fits, now full
    assert w.put(7, "d") == []
    assert [i for _, held in w.put(9, "e") for _, _, i in held] == ["d"]  # none fits: the fullest goes


def test_packing_edges(spark):
    assert packing.pack(table(spark, [])).count() == 0
