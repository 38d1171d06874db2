r"""Quality rules: figures of each text, and lines that repeat across documents of a host.

Lines are normalised (words lower-cased A-Z, joined by one space) and hashed.
For each host the distinct documents with a line are counted, where documents
of one text count once: a line's frequency says how common it is as template,
not how often a page was copied. Lines in more documents than the limit are
removed, except in the document with the smallest id that has them, so that
one carrier of a shared text always stays whole. A document is rejected when
what is left is too little of it (depleted), or when its own figures are bad.

Distinct counting dedupes (host, line, text) before it counts, the frequent
lines are few beside all lines, and a hot line's rows are salted when they
meet it again.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import SPACE, ascii_lower, documents

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more distinct texts of a host than this is template.
MAX_LINE_DOCS = 10
#: A document of which less than this percentage of words is left is depleted.
MIN_LEFT_PERCENT = 50
SALTS = 16

_SYMBOL = re.compile(r"[#*$%&|<>]")
_WHITE = re.compile(r"[\x20\x09-\x0D]")


def text_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()  # bytes split at ASCII white space only
    n = len(ws)
    chars = len(text) - len(_WHITE.findall(text))
    symbols = len(_SYMBOL.findall(text))
    lines = raw.split(b"\n")
    dup_lines = 0
    if len(lines) > 1:
        counts = Counter(line for line in lines if line and line.strip())
        dup_lines = sum(counts.values()) - len(counts)
    repeat = 0
    if n > 3:
        trigrams = list(zip(ws, ws[1:], ws[2:], strict=False))
        counts = Counter(trigrams)
        if len(counts) < len(trigrams):
            end = 0  # first word not yet counted
            for i, t in enumerate(trigrams):
                if counts[t] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, dup_lines, repeat


#: What tells documents apart: rows that agree on all three are treated alike.
DOCUMENT = ["host", "doc_id", "text_hash"]
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _figures(batches):
    for batch in batches:
        rows = [text_figures(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, DOCUMENT), *[pa.array(c, pa.int64()) for c in columns]],
            names=[*DOCUMENT, *FIGURES],
        )


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), SPACE, " "))


def line_rows(df: DataFrame, host: str) -> DataFrame:
    """One row for each line that has words, of each row of df, repeated lines too: doc_id, host, text hash, the line's place, its hash and words."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), normal_line)
    rows = df.select("doc_id", F.col(host).alias("host"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines).alias("place", "line")).filter("line != ''")
    rows = rows.select("doc_id", "host", "text_hash", "place", F.xxhash64("line").alias("line_hash"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"))
    return rows


def frequent_lines(lines: DataFrame, limit: int) -> DataFrame:
    """(host, line_hash, first_doc) of lines in more than limit distinct texts of their host."""
    once = lines.groupBy("host", "line_hash", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    by = once.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return by.filter(F.col("n_docs") > limit)


def removed_lines(df: DataFrame, host: str = "source", limit: int = MAX_LINE_DOCS) -> DataFrame:
    """(host, doc_id, text_hash, removed, lines): words in and hashes of the lines above the limit, for documents that lose any.

    A line counts once for its place in the text, however many rows repeat the
    document; the same document under another host is judged by that host's lines.
    """
    lines = line_rows(df, host)
    salted = frequent_lines(lines, limit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(SALTS)).cast("int"))
    same = [spread["host"].eqNullSafe(salted["host"]), spread["line_hash"] == salted["line_hash"], spread["salt"] == salted["salt"]]
    later = ~spread["doc_id"].eqNullSafe(salted["first_doc"])
    hit = spread.join(salted, [*same, later]).select(spread["host"], spread["doc_id"], "text_hash", F.struct("place", "n", spread["line_hash"]).alias("hit"))
    once = hit.groupBy(*DOCUMENT).agg(F.collect_set("hit").alias("hits"))
    removed = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return once.select(*DOCUMENT, removed.alias("removed"), F.array_distinct("hits.line_hash").alias("lines"))


def quality(df: DataFrame, host: str = "source", limit: int = MAX_LINE_DOCS) -> DataFrame:
    """(host, doc_id, text_hash, figures, removed, lines, base_failed, kept), one row for each row of df.

    Null texts are empty and fail. A null host is a host of its own. Rows that
    repeat host, id and text are treated alike; an empty table gives no rows.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", F.col(host).alias("host"))
    kind = rows.schema["host"].dataType.simpleString()
    figures = rows.select(*DOCUMENT, "text").mapInArrow(_figures, f"host {kind}, " + ", ".join(f"{c} long" for c in [*DOCUMENT[1:], *FIGURES]))
    gone = removed_lines(rows, "host", limit)
    out = _by_document(figures, gone, "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("removed")) < MIN_LEFT_PERCENT * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def _by_document(left: DataFrame, right: DataFrame, how: str, names: list[str] = DOCUMENT) -> DataFrame:
    """left, whose columns `names` are DOCUMENT's, joined with right."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in DOCUMENT})
    host, doc, text_hash = (left[n] for n in names)
    on = host.eqNullSafe(right["_r_host"]) & doc.eqNullSafe(right["_r_doc_id"]) & (text_hash == right["_r_text_hash"])
    return left.join(right, on, how).drop(*[f"_r_{c}" for c in DOCUMENT])


def clean(df: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, without their lines above the limit; other columns as they were, n_chars after the text."""
    good = quality(df, host).filter("kept").select(*DOCUMENT, F.coalesce("lines", F.array().cast("array<bigint>")).alias("_lines")).dropDuplicates(DOCUMENT)
    out = _by_document(df.withColumn("_own", F.xxhash64("text")), good, "inner", [host, "doc_id", "_own"]).drop("_own")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("_lines", F.xxhash64(normal_line(x)))), "\n")
    out = out.withColumn("text", F.when(F.size("_lines") == 0, F.col("text")).otherwise(left))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(df.columns)


def op1(spark, sf_dir):
    return quality(documents(spark, sf_dir)).drop("host", "text_hash", "lines")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT row, line FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT row, sum(n - 1) AS n_dup_lines FROM (SELECT row, line, count(*) AS n FROM l GROUP BY ALL) GROUP BY row),
g AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT row, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY row, tri) AS n FROM g) WHERE n > 1),
rep AS (SELECT row, count(DISTINCT pos) AS n_repeat_words FROM r GROUP BY row),
nl AS (SELECT l.row, d.doc_id, d.source, d.text, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line FROM l JOIN d USING (row)),
f AS (SELECT source, line, min(doc_id) AS first_doc FROM nl GROUP BY ALL HAVING count(DISTINCT text) > {MAX_LINE_DOCS}),
gone AS (SELECT nl.row, sum(len(string_split(nl.line, ' '))) AS removed FROM nl JOIN f ON nl.source IS NOT DISTINCT FROM f.source AND nl.line = f.line AND nl.doc_id IS DISTINCT FROM f.first_doc GROUP BY 1),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed
  FROM w LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) LEFT JOIN gone USING (row))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * (n_words - removed) >= {MIN_LEFT_PERCENT} * n_words AS kept FROM x"""
