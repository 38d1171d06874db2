r"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression. `split` and `regexp_extract_all` with one
pattern give the text between matches and the matches; a fold over both gives
each match's place. Patterns are written with possessive quantifiers and start
guards, so that they take time linear in the text while they match what the
plain patterns match.

Context words are looked for, as whole words, in the CONTEXT_CHARS characters on
each side of a match; beyond the neighbouring match of the same kind they reach
up to the match after that one.

Spans are code points, the end exclusive. Kinds may overlap each other; within
a kind matches are leftmost and do not overlap. Null and empty texts have no
spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import documents

CONTEXT_CHARS = 40
ACCEPT = 0.5
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """sign: what a text must hold for the pattern to be tried. plain: the same matches for an engine without possessive quantifiers."""

    name: str
    pattern: str
    plain: str
    sign: str
    base: bool
    score: float
    words: str


_LOCAL = "A-Za-z0-9._%+-"
KINDS = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"[{_LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", True, 0.8, "mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "[0-9]\\.[0-9]", True, 0.6, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", "[0-9]", True, 0.9, "card|credit|visa|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", True, 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", False, 0.9, "iban|bank|account"),
    Kind("ssn", r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++", r"[0-9]+-[0-9]+-[0-9]+", "[0-9]-[0-9]", False, 0.3, "ssn|social|security"),
]
PART_OF_IP = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_OK = rf"^{PART_OF_IP}\.{PART_OF_IP}\.{PART_OF_IP}\.{PART_OF_IP}$".replace("0*(", "0*+(").replace("[1-9]?[0-9])", "[1-9][0-9]?|)")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def mod97(code: Column) -> Column:
    """Remainder of an account number, its first four characters moved behind and letters read as 10 to 35."""
    moved = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    at = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substr(moved, i, F.lit(1))))
    return F.aggregate(at, F.lit(0), lambda acc, c: F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97)


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(IP_OK)
    if kind == "card":
        return F.length(_digits(hit)).between(16, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        code = F.replace(hit, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & (mod97(code) == 1)
    if kind == "ssn":
        return hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return hit.isNotNull()


#: Matches of a text that are folded at once, so that no list is copied once for each match.
PART = 256


def _near(kind: Kind, before: Column, after: Column) -> Column:
    """Whether a context word stands, as a word of its own, within CONTEXT_CHARS on either side."""
    words = rf"(^|[^a-z])(?:{kind.words})($|[^a-z])"
    return F.lower(F.right(before, F.lit(CONTEXT_CHARS))).rlike(words) | F.lower(F.left(after, F.lit(CONTEXT_CHARS))).rlike(words)


def _iban(hit: Column) -> Column:
    """The longest run of a match's groups that is an account number; null where none is. A word behind the number may look like a group."""
    groups = F.split(hit, " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
    return F.try_element_at(F.filter(runs, lambda run: valid("iban", run)), F.lit(1))


def proposed(text: Column, kind: Kind) -> Column:
    """(before, hit) for each match of a kind, and one more with the rest of the text, whose hit is null."""
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda before, hit: F.struct(before.alias("before"), hit.alias("hit")),
    )
    return F.when(text.rlike(kind.sign), pairs).otherwise(F.array().cast("array<struct<before:string,hit:string>>"))


def judged_of(pairs: Column, kind: Kind) -> Column:
    """What is known of each proposed match: the text before it, its length, the length that is confirmed, and its score."""
    text_of = lambda i, field: F.coalesce(F.get(pairs, i)[field], F.lit(""))

    def judge(x: Column, i: Column) -> Column:
        before = F.concat(text_of(i - 1, "before"), text_of(i - 1, "hit"), x["before"])
        after = F.concat(text_of(i + 1, "before"), text_of(i + 1, "hit"), text_of(i + 2, "before"))
        score = F.when(_near(kind, before, after), F.lit(min(1.0, round(kind.score + 0.2, 2)))).otherwise(F.lit(kind.score))
        held = _iban(x["hit"]) if kind.name == "iban" else F.when(valid(kind.name, x["hit"]), x["hit"])
        return F.struct(
            F.length(x["before"]).alias("skip"),
            F.coalesce(F.length(x["hit"]), F.lit(0)).alias("wide"),
            F.length(held).alias("held"),
            # context costs, so only what is confirmed is looked at
            F.when(held.isNotNull(), score).alias("score"),
        )

    return F.transform(pairs, judge)


def spans_of(judged: Column, kind: Kind) -> Column:
    """The spans of a kind, from what is known of its matches."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + x["held"]).alias("end"), x["score"].alias("score"))
        good = x["held"].isNotNull() & (F.lit(True) if kind.base else x["score"] >= ACCEPT)
        return F.struct((start + x["wide"]).alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def part(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
        # an array of one gives the part's result a name, so that it is folded once
        return F.element_at(F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["outs"], r["out"]).alias("outs"))), 1)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(judged) - 1) / PART).cast("int")), lambda n: F.slice(judged, n * PART + 1, F.lit(PART)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("outs"))
    return F.when(F.size(judged) > 0, F.flatten(F.aggregate(parts, zero, part, lambda acc: acc["outs"]))).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the spans of every kind, by kind as listed and then start; a column of the same name is replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # each step is a column of its own: a match list that a lambda looks into is made once for a row
    made = df.withColumns({f"_pairs_{k.name}": proposed(whole, k) for k in KINDS})
    made = made.withColumns({f"_judged_{k.name}": judged_of(F.col(f"_pairs_{k.name}"), k) for k in KINDS})
    return made.withColumn(out, F.concat(*[spans_of(F.col(f"_judged_{k.name}"), k) for k in KINDS])).drop(*[f"_{c}_{k.name}" for c in ("pairs", "judged") for k in KINDS])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of the text replaced by its kind in brackets; spans that overlap become one. A null text stays null."""
    found = find_pii(df, text, "_pii").withColumn("_pii", F.array_sort(F.transform("_pii", lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    source = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.substr(source, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(acc["parts"], F.array(kept, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["parts"]).alias("parts"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate("_pii", zero, step, lambda acc: F.array_join(F.array_append(acc["parts"], F.substr(source, acc["at"] + 1)), ""))
    return found.withColumn(text, F.when(source.isNull() | (F.size("_pii") == 0), source).otherwise(clean)).drop("_pii")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2(spark, sf_dir):
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    base = [k.name for k in KINDS if k.base]
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        "doc_id",
        *[count(k.name) for k in KINDS],
        F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


def _oracle() -> str:
    checks = {
        "email": "true",
        "ip": "regexp_matches(hit, '^" + rf"{PART_OF_IP}\.{PART_OF_IP}\.{PART_OF_IP}\.{PART_OF_IP}" + "$')",
        "card": """length(d) BETWEEN 16 AND 19 AND (SELECT sum(CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN 2 * v > 9 THEN 2 * v - 9 ELSE 2 * v END ELSE v END)
   FROM (SELECT unnest(range(1, length(d) + 1)) AS i, CAST(unnest(string_split(d, '')) AS INTEGER) AS v)) % 10 = 0""",
        "phone": "length(d) BETWEEN 8 AND 15",
        "ssn": "regexp_matches(hit, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')",
    }
    account = """length(replace(g, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(g, ' ', ''), 5) || left(replace(g, ' ', ''), 4), ''), lambda c: ascii(c))),
   lambda acc, c: CASE WHEN c >= 65 THEN (acc * 100 + c - 55) % 97 ELSE (acc * 10 + c - 48) % 97 END) = 1"""
    runs = "list_transform(range(len(string_split(hit, ' ')), 0, -1), lambda n: array_to_string(string_split(hit, ' ')[:n], ' '))"
    parts, good = [], []
    for i, k in enumerate(KINDS):
        held = f"list_filter({runs}, lambda g: {account})[1]" if k.name == "iban" else f"CASE WHEN {checks[k.name]} THEN hit END"
        words = f"'(^|[^a-z])({k.words})($|[^a-z])'"
        high = min(1.0, round(k.score + 0.2, 2))
        parts.append(f"""h{i} AS (SELECT doc_id, unnest(list_append(hits, NULL)) AS hit, unnest(string_split_regex(text, '{k.plain}')[:len(hits) + 1]) AS piece, unnest(range(1, len(hits) + 2)) AS i
 FROM (SELECT doc_id, text, regexp_extract_all(text, '{k.plain}') AS hits FROM t) WHERE len(hits) > 0),
w{i} AS (SELECT *, sum(length(piece) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS d,
 coalesce(lag(piece) OVER o, '') || coalesce(lag(hit) OVER o, '') || piece AS before, coalesce(lead(piece) OVER o, '') || coalesce(lead(hit) OVER o, '') || coalesce(lead(piece, 2) OVER o, '') AS after FROM h{i} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p{i} AS (SELECT {i} AS ord, '{k.name}' AS kind, doc_id, CAST(stop - length(hit) AS BIGINT) AS start, {held} AS held,
 CASE WHEN regexp_matches(lower(right(before, {CONTEXT_CHARS})), {words}) OR regexp_matches(lower(left(after, {CONTEXT_CHARS})), {words}) THEN {high} ELSE {k.score} END AS score FROM w{i} WHERE hit IS NOT NULL)""")
        good.append(f"SELECT doc_id, ord, kind, start, start + length(held) AS stop, score FROM p{i} WHERE held IS NOT NULL{'' if k.base else f' AND score >= {ACCEPT}'}")
    base = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(parts)},
s AS ({" UNION ALL ".join(good)}),
g AS (SELECT doc_id, {counts},
 coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (kind IN ({base})), '') AS base,
 coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start), '') AS spans,
 coalesce(string_agg(format('{{:.1f}}', CAST(score AS DOUBLE)), ',' ORDER BY ord, start), '') AS scores FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
