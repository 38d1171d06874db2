from waywarden.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document(i):
    template = [" ".join(f"t{k}w{w}" for w in range(15)) for k in range(2)]
    return "\n".join([*template, " ".join(f"own{i}w{w}" for w in range(70))])


def test_repeated_rows_below_the_limit_stay(spark):
    """30 of 100 words are template: a document that is listed twice or three times loses no more of them."""
    rows = [(i, document(i), "en", "h", 1) for i in range(20)]
    rows += [rows[5]] + [rows[6]] * 2 + [(None, document(98), "en", "h", 1)] * 3 + [(7, document(7), "en", "other", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    q = quality.quality(df).collect()
    assert len(q) == len(rows) and all(r["kept"] for r in q)
    # a null id sorts behind none: document 0 is the first carrier; a line of one document is no template of the other host
    assert all(r["removed"] == (0 if r["doc_id"] == 0 or r["host"] == "other" else 30) for r in q)
    assert quality.clean(df).count() == len(rows)


def test_a_line_repeated_inside_one_text_counts_each_time(spark):
    line = " ".join(f"t{w}" for w in range(20))
    rows = [(i, "\n".join([line, line, line, " ".join(f"own{i}w{w}" for w in range(40))]), "en", "h", 1) for i in range(15)]
    q = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert q[3]["removed"] == 60 and not q[3]["kept"] and q[0]["removed"] == 0


def test_each_host_judges_by_its_own_lines(spark):
    """One id and text under two hosts: 30 of its 100 words are template in both, and count once in each."""
    rows = [(20 * k + i, document(20 * k + i), "en", f"h{k}", 1) for k in range(2) for i in range(15)]
    rows += [(50, document(50), "en", h, 1) for h in ("h0", "h1", None)]
    q = quality.quality(spark.createDataFrame(rows, SCHEMA)).filter("doc_id = 50").collect()
    assert {r["host"]: r["removed"] for r in q} == {"h0": 30, "h1": 30, None: 0} and all(r["kept"] for r in q)


def test_entry_equals_its_sql_where_rows_repeat(spark, tmp_path):
    import duckdb

    rows = [(i, document(i), "en", "h", 1) for i in range(20)]
    rows += [rows[5]] * 2 + [(None, document(98), "en", "h", 1)] * 2 + [(3, None, None, None, None), (4, "", "en", "h", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(quality.ORACLE)
    got = quality.op1(spark, str(tmp_path))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got.select(*want.columns).collect(), key=key) == sorted(want.fetchall(), key=key)
