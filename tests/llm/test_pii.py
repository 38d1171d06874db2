import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.data import table
from waywarden.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k in pii.KINDS[:4]:
        for m in re.finditer(k.plain, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if k.name == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[k.name]
            if ok:
                out.append((k.name, m.start(), m.end()))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = pii.find_pii(df).collect()
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["score"]) for s in r["pii"]] for r in got}


TRICKY = [
    "a@b.c_d@e.f", "x@y", "mail a.b+c@d-e.co.uk, z@q.io.", "@@a@b.cc@d.ee", "1.2.3.4.5.6.7.8", "256.1.1.1 and 0001.002.3.255", "1.2.3", "4539 1488 0343 6467 x", "4539148803436467", "4539-1488-0343-6468",
    "+1 (555) 123-4567 call", "+12", "+1234567890123456", "é+44 20 7946 0958é", "", " ", "4539 1488 0343 6467 4539 1488 0343 6467", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a" * 3000 + "@b.c", "1" * 5000, ("a." * 2000) + "@" + "b." * 2000 + "c",
    "😀 a@b.cd 😀", "+1 2.3.4.5 6-7 8",
]


def test_base_matches_brute_force(spark):
    got = found(spark, TRICKY)
    for i, t in enumerate(TRICKY):
        assert [s[:3] for s in got[i] if s[0] in ("email", "ip", "card", "phone")] == brute(t), t


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a@.1234567890-+ ()b_5é", max_size=60), min_size=20, max_size=60))
def test_base_matches_brute_force_on_noise(spark, rows):
    got = found(spark, rows)
    for i, t in enumerate(rows):
        assert [s[:3] for s in got[i] if s[0] in ("email", "ip", "card", "phone")] == brute(t), t


def test_checksums_and_context(spark):
    got = found(spark, ["IBAN GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789", "part 123-45-6789", "write to a@b.cd"])
    assert [s[0] for s in got[0] if s[0] == "iban"] == ["iban"] and not [s for s in got[1] if s[0] == "iban"]
    assert [s[0] for s in got[2]] == ["ssn"] and not got[3] and got[4][0][3] == 1.0


def test_context_on_both_sides_and_as_words(spark):
    got = found(spark, ["ssn 123-45-6789, 987-65-4321", "123-45-6789 is my ssn", "assn 123-45-6789", "a description 10.0.0.1", "my IP: 10.0.0.1", "mailbox a@b.cd", "contact: a@b.cd " + "x" * 60 + " c@d.ef", "123-45-6789" + " " * 60 + "ssn"])
    assert [s[:3] for s in got[0]] == [("ssn", 4, 15), ("ssn", 17, 28)] and [s[0] for s in got[1]] == ["ssn"] and not got[2] and not got[7]
    assert got[3][0][3] == 0.6 and got[4][0][3] == 0.8 and got[5][0][3] == 0.8 and [s[3] for s in got[6]] == [1.0, 0.8]


def test_account_numbers_before_capital_words(spark):
    rows = ["IBAN AT611904300234573201 HELP ME", "AT61 1904 3002 3457 3201 HELP", "GB82 WEST 1234 5698 7654 32 AB", "DE89 3704 0044 0532 0130 00 DE89 3704 0044 0532 0130 00"]
    got = found(spark, rows)
    assert [rows[0][s[1] : s[2]] for s in got[0] if s[0] == "iban"] == ["AT611904300234573201"]
    assert [rows[1][s[1] : s[2]] for s in got[1] if s[0] == "iban"] == ["AT61 1904 3002 3457 3201"]
    assert [rows[2][s[1] : s[2]] for s in got[2] if s[0] == "iban"] == ["GB82 WEST 1234 5698 7654 32"] and got[3]


def test_a_text_with_very_many_matches(spark):
    n = 30_000
    got = found(spark, ["".join(f"u{i}@b.cd " for i in range(n)), "x " * 200_000 + "a@b.cd"])
    assert len(got[0]) == n and got[0][-1][2] == sum(len(f"u{i}@b.cd ") for i in range(n)) - 1 and got[1][0][1] == 400_000


def test_entry_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [*TRICKY, None, "ssn 123-45-6789, 987-65-4321 x", "AT61 1904 3002 3457 3201 HELP", "mailbox a@b.cd or contact c@d.ef", "call +1 555 123 45 67, fax +1 555 123 45 68"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(pii.ORACLE)
    assert sorted(pii.op2(spark, str(tmp_path)).select(*want.columns).collect()) == sorted(want.fetchall())


def test_redact(spark):
    df = spark.createDataFrame([(1, "a@b.cd, b@c.de!"), (2, None), (3, "none"), (4, "+1 555 123 45 67 and 4539148803436467")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["[email], [email]!", None, "none", "[phone] and [card]"]


def test_edges(spark):
    df = table(spark, extra=True)
    assert pii.find_pii(df).count() == df.count() and pii.redact(df).columns == df.columns
    assert pii.find_pii(table(spark, [])).count() == 0


@pytest.mark.parametrize("code,ok", [("GB82WEST12345698765432", True), ("DE89370400440532013000", True), ("DE89370400440532013001", False)])
def test_mod97(spark, code, ok):
    from pyspark.sql import functions as F

    assert (spark.range(1).select(pii.mod97(F.lit(code)).alias("m")).head()["m"] == 1) is ok
