import random

import pytest

from tests.llm.data import near, table, texts, words
from tests.llm.plain import classes as brute
from waywarden.llm import near_dup
from waywarden.operators.graph import components


@pytest.mark.parametrize("rule", [near_dup.Rule(3, 85), near_dup.Rule()])
def test_matches_brute_force(spark, rule):
    df = table(spark, extra=True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, rule).collect()}
    assert got == brute([(i if i != 4 else None, t) for i, t in enumerate(texts())], rule)


def test_family_that_no_single_leader_joins(spark):
    """Near copies of one text at growing distance: chains, strays and a hot bucket that only the finish resolves."""
    rng = random.Random(5)
    base = words(rng, 220, 10**6)
    rows = [" ".join(near(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.04]))) for _ in range(150)]
    walk = base
    for _ in range(25):
        walk = near(rng, walk, 0.015)
        rows.append(" ".join(walk))
    rule = near_dup.Rule(3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(table(spark, rows), rule).collect()}
    assert got == brute([(i if i != 4 else None, t) for i, t in enumerate(rows)], rule)


@pytest.mark.parametrize("rule", [near_dup.Rule(3, 85), near_dup.Rule()])
def test_recall_of_pairs_at_the_threshold(spark, rule):
    """Pairs that barely reach the limit are all found by bands and pruning; those barely below are not linked."""
    rng, rows, linked = random.Random(11), [], []
    while len(linked) < 400:
        one = words(rng, 150, 10**6)
        two = list(one)
        for i in rng.sample(range(150), rng.randrange(2, 8)):
            two[i] = f"y{rng.randrange(10**6)}"
        a, b = (near_dup.shingles(" ".join(x), rule.words) for x in (one, two))
        similar = 100 * len(a & b) / len(a | b)
        if rule.percent - 6 <= similar <= rule.percent + 4:
            rows += [" ".join(one), " ".join(two)]
            linked.append(similar >= rule.percent)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), rule).collect()}
    assert 50 < sum(linked) < 350 and [got[2 * i + 1] == 2 * i for i in range(400)] == linked


def test_hot_buckets_are_spread(spark, monkeypatch):
    """With salts for buckets of three and more, tiles of a few documents and of a few shingles, the result is the same."""
    rng = random.Random(6)
    base = words(rng, 160, 10**6)
    rows = [" ".join(near(rng, base, rng.choice([0.0, 0.02, 0.04, 0.06]))) for _ in range(90)]
    rule = near_dup.Rule(3, 85)
    for name, value in (("HOT", 2), ("TILE", 7), ("TILE_SHINGLES", 900), ("LEADER_ROUNDS", 1)):
        monkeypatch.setattr(near_dup, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(table(spark, rows), rule).collect()}
    assert got == brute([(i if i != 4 else None, t) for i, t in enumerate(rows)], rule)


def test_keep_first(spark):
    rows = ["a b c d e f g", "A B c d e f g", None, "other text of its own kind", "x y"]
    df = table(spark, rows, extra=True)
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "a b c d e f g", "other text of its own kind", "x y"]


def test_an_id_with_several_texts_joins_their_groups(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, a), (2, a), (3, a), (3, b), (4, b), (5, "else and other"), (6, None), (7, ""), (8, "x y z"), (8, "x y z w v u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, near_dup.Rule(3, 85)).collect()]
    assert sorted(got) == [(1, 6, 1), (1, 6, 1), (2, 6, 1), (3, 6, 1), (3, 6, 1), (4, 6, 1), (5, 1, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (8, 4, 8)]


def test_empty(spark):
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    of = {x: x for e in links for x in e}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    assert got == {x: root(x) for x in of if any(x in e and e[0] != e[1] for e in links)}


def test_pruning_keeps_what_may_reach_the_threshold():
    rule = near_dup.Rule(3, 85)
    assert all(0 < m < n for m, n in zip(near_dup.least_matches(rule), range(near_dup.BATCH, 999, near_dup.BATCH), strict=False)) and (1 - 0.85**near_dup.ROWS) ** rule.bands <= rule.miss
