import corpus_pipeline
from tests.llm.data import table, texts


def test_stages_in_order_and_their_columns(spark, tmp_path):
    rng_rows = [*texts(), *[f"Contact a{i}@b.cd now " + " ".join(f"q{i}w{k}" for k in range(60)) for i in range(10)]]
    table(spark, rng_rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        seen.append((name, docs.count()))
    assert [n for n, _ in seen] == ["quality rules", "near-dedup", "PII", "mixing"]
    assert seen[0][1] < len(rng_rows) and seen[1][1] < seen[0][1] and seen[2][1] == seen[1][1]
    assert not docs.filter("text LIKE '%@b.cd%'").count()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096 and pieces.ids.map(len).eq(4 * pieces.length).all()


def test_every_stage_equals_a_plain_one(spark, tmp_path):
    """Which documents each stage keeps, what their texts become, how often they are taken, and which ids result."""
    import random
    import re
    from collections import Counter

    import corpus_pipeline
    from tests.llm import plain
    from tests.llm.data import SCHEMA, near, words
    from tests.llm.test_tokens import reference
    from waywarden.llm import mixing, near_dup, packing

    rng, docs = random.Random(21), []
    for i in range(140):
        ws = words(rng, rng.choice([40, 70, 160, 400]), 4000)
        source = ("a", "b", "c", None)[i % 4]
        text = "\n".join([f"Terms of {source} use apply here", " ".join(ws[: len(ws) // 2]), " ".join(ws[len(ws) // 2 :])])
        if i % 9 == 0:
            text += f"\nwrite to user{i}@example.org, or call +1 555 123 45{i:02d}"
        if i % 13 == 0:
            text += "\n" + "again and again " * 300
        docs.append((i, text, "en", source, len(text)))
        if i % 6 == 0:
            copy = " ".join(near(rng, text.split(" "), 0.01))
            docs.append((1000 + i, copy, "en", source, len(copy)))
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")

    stages, frames = dict(corpus_pipeline.STAGES), {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in stages.items():
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        frames[name] = now = spark.read.parquet(f"{tmp_path}/{name}")
    key = lambda rows: sorted(rows, key=lambda r: r[0])

    want = plain.cleaned([(i, t, s) for i, t, _, s, _ in docs])
    assert key(held_(frames["quality rules"])) == key(want) and 60 < len(want) < len(docs)
    of = plain.classes([(i, t) for i, t, _ in want], near_dup.Rule())
    want = [r for r in want if of[r[0]][1] == r[0]]
    assert key(held_(frames["near-dedup"])) == key(want)
    redacted = lambda t: re.sub(r"\+[0-9][\x20().0-9-]+[0-9]", "[phone]", re.sub(r"user[0-9]+@example\.org", "[email]", t))
    want = [(i, redacted(t), s) for i, t, s in want]
    assert key(held_(frames["PII"])) == key(want) and any("[phone]" in t for _, t, _ in want)
    us = {r["doc_id"]: r["u"] for r in frames["PII"].select("doc_id", mixing._unit("doc_id", "text").alias("u")).collect()}
    taken, _, _ = plain.mixed(want, us)
    copies = Counter({i: taken[i] // len(plain.split(t)) for i, t, _ in want})
    got = Counter(r["doc_id"] for r in frames["mixing"].collect())
    assert sum((got - +copies).values()) + sum((+copies - got).values()) <= 2
    pieces = frames["packing"].toPandas()
    for i, t, _ in want:
        ids, = reference(packing.FILE, [t], packing.END)
        mine = pieces[pieces.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) * got[i] and (mine.doc_tokens == len(ids)).all()
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= packing.WINDOW


def held_(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
