import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import table, texts
from waywarden.llm import hmm


@pytest.fixture(scope="module")
def scored(spark):
    out, model, trace = hmm.score(table(spark, extra=True).repartition(3))
    return out.toPandas(), model, trace


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def test_base_counts_and_likelihood(scored):
    out, model, _ = scored
    rows = {i if i != 4 else None: t for i, t in enumerate(texts())}
    c = Counter(w for i, t in rows.items() if not hmm.held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    own, k = model.own, len(model.own)
    cls = lambda w: own[w] if w in own else k + zlib.crc32(w) % hmm.SHARED
    total, kinds = Counter(), Counter()
    for w, x in c.items():
        if w not in own:
            total[cls(w)] += x
            kinds[cls(w)] += 1
    for r in out.itertuples():
        ts = tokens(rows[None if np.isnan(r.doc_id) else int(r.doc_id)])
        assert r.n_tokens == len(ts) and r.n_known == sum(c[w] > 0 for w in ts) and r.train_tokens == n
        assert np.isclose(r.base_score, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ts))
        state, score = None, 0.0
        for w in ts:
            inner = 1.0 if w in own else (c[w] + 1) / (total[cls(w)] + kinds[cls(w)] + 1)
            state = (model.start if state is None else state @ model.move) * model.emit[cls(w)] * inner
            score += np.log10(state.sum())
            state = state / state.sum()
        assert np.isclose(r.score, score, rtol=1e-9)


def test_training_raises_the_likelihood(scored):
    trace = scored[2]
    gains = np.diff(trace)
    assert 2 <= len(trace) <= hmm.STEPS and (gains > -1e-9).all()
    # it goes on while it pays, and no longer
    assert (gains[:-1] >= hmm.GAIN).all() and (len(trace) == hmm.STEPS or gains[-1] < hmm.GAIN)


def test_classes_grow_with_the_vocabulary():
    sizes = [hmm.class_numbers(v) for v in (0, 10**4, 10**6, 10**8, 10**10)]
    assert sizes[0] == (hmm.OWN, hmm.SHARED) and all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(sizes, sizes[1:], strict=False))
    assert sizes[3][0] > 30 * hmm.OWN and sizes[4][0] * hmm.STATES * 8 < 1 << 26


def test_latent_states_beat_word_counts_on_held_out_text(spark):
    """Texts in one of four subjects each: states learn them, word counts alone can not."""
    rng = np.random.default_rng(4)
    rows = [" ".join(f"s{i % 4}w{w}" if rng.random() < 0.7 else f"c{w}" for w in rng.zipf(1.4, 120) % 300) for i in range(400)]
    out, model, trace = hmm.score(table(spark, rows), steps=8)
    held = out.filter("held_out").toPandas()
    assert len(held) > 30 and (held.score - held.base_score).sum() / held.n_tokens.sum() > 0.02
    assert (held.score > held.base_score).mean() > 0.9


def test_model_is_a_distribution(scored):
    m = scored[1]
    assert np.isclose(m.start.sum(), 1) and np.allclose(m.move.sum(axis=1), 1) and np.allclose(m.emit.sum(axis=0), 1)


def test_expected_counts_match_plain_forward_backward():
    rng = np.random.default_rng(3)
    k, c = 3, 7
    m = hmm.Model({}, rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    docs = [rng.integers(0, c, n) for n in (1, 2, 63, 64, 65, 200, 5, 255, 256, 257, 511, 513, 1500)]
    got = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    like = hmm._Segments(np.concatenate(docs), np.array(list(map(len, docs)))).expect(m, got)
    want, total = (np.zeros(k), np.zeros((k, k)), np.zeros((c, k))), 0.0
    for d in docs:
        a = [m.start * m.emit[d[0]]]
        for x in d[1:]:  # each divided by its sum, as 1500 tokens' likelihood is no number
            total += np.log(a[-1].sum())
            a[-1] = a[-1] / a[-1].sum()
            a.append(a[-1] @ m.move * m.emit[x])
        total += np.log(a[-1].sum())
        b = [np.ones(k)]
        for x in d[:0:-1]:
            now = m.move @ (m.emit[x] * b[0])
            b.insert(0, now / now.sum())
        want[0][:] += a[0] * b[0] / (a[0] * b[0]).sum()
        for t, x in enumerate(d):
            want[2][x] += a[t] * b[t] / (a[t] * b[t]).sum()
            if t:
                flow = np.outer(a[t - 1], m.emit[x] * b[t]) * m.move
                want[1][:] += flow / flow.sum()
    assert np.isclose(like, total) and all(np.allclose(g, w) for g, w in zip(got, want, strict=True))


def test_edges(spark):
    out, _, _ = hmm.score(table(spark, []))
    assert out.count() == 0
    out, _, _ = hmm.score(table(spark, [None, ""]))
    assert out.count() == 2
