from collections import Counter, defaultdict

import pytest

from tests.llm.data import table, texts
from waywarden.llm import quality


def brute(rows):
    out = {}
    lines = defaultdict(set)
    norm = lambda x: " ".join(x.encode().lower().decode().split(" ")).strip()
    import re

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t, host in rows:
        ws = split(t)
        tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {p for k, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if tri[g] > 1 for p in (k, k + 1, k + 2)}
        ls = [x for x in (t or "").split("\n") if split(x)]
        out[i] = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(hit))
    return out


def test_figures_match_brute_force(spark):
    rows = [*texts(), "a b c a b c", "x\ny\nx\n \nx", "#*$ % & | < > plain", "a a a a a"]
    df = table(spark, rows, extra=True)
    got = {r["doc_id"]: tuple(r[f] for f in quality.FIGURES) for r in quality.quality(df).collect()}
    want = brute([(i if i != 4 else None, t, None) for i, t in enumerate(rows)])
    assert got == want


@pytest.fixture(scope="module")
def template(spark):
    body = lambda i: "\n".join(" ".join(f"d{i}l{k}w{w}" for w in range(30)) for k in range(4))
    rows = [f"Read our terms of use here\n{body(i)}" for i in range(30)] + ["\n".join(["Read our terms  of USE here", "all rights reserved by nobody"] + [f"t{k} t t" for k in range(20)])] + [body(0)] * 40
    return spark.createDataFrame([(i, t, "en", "one", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_frequent_lines_go_but_for_the_first_carrier(spark, template):
    out = {r["doc_id"]: r for r in quality.clean(template).collect()}
    assert out[0]["text"].startswith("Read our terms") and not out[5]["text"].startswith("Read our terms")
    assert out[5]["n_chars"] == len(out[5]["text"])
    # forty copies of one text are one text: its lines are no template
    assert len([i for i in out if i >= 31]) == 40


def test_depleted(spark):
    shared = "\n".join(" ".join(f"s{k}w{w}" for w in range(20)) for k in range(4))
    rows = [(i, f"{shared}\nown words {i}", "en", "h", 1) for i in range(20)]
    q = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert q[0]["kept"] and not any(q[i]["kept"] for i in range(1, 20)) and not q[3]["base_failed"] and q[3]["removed"] == 80


def test_edges(spark):
    assert quality.quality(table(spark, [])).count() == 0 and quality.clean(table(spark, [])).count() == 0
    df = table(spark, extra=True)
    assert quality.clean(df).columns == df.columns
