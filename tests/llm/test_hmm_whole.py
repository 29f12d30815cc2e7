"""Every token above a fixed count has emissions of its own, and texts are not cut, whatever the table's size."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.llm import hmm


def test_scores_do_not_depend_on_the_head(docs, monkeypatch):
    def scores():
        key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])
        return [(*key(r)[:2], r["n_known"], r["base_score"], r["score"]) for r in sorted(hmm.language_model(docs).collect(), key=key)]

    want = scores()
    monkeypatch.setattr(hmm, "HEAD", 300)
    for a, b in zip(scores(), want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_expectations_of_a_long_text_are_those_of_the_whole():
    rng = np.random.default_rng(2)
    k, n = hmm.STATES, 3 * hmm.SEGMENT + 11
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm.Chain(norm(rng.random(k)), norm(rng.random((k, k)) ** 4), norm(rng.random((k, 6)) ** 4).T, np.full(k, 1 / k))
    texts = [rng.integers(0, 6, x) for x in (5, n, 1, hmm.SEGMENT, 2 * hmm.SEGMENT)]
    e, a, s = np.zeros((6, k)), np.zeros((k, k)), np.zeros(k)
    for o in texts:
        f, g = [m.start * m.emit[o[0]]], [np.ones(k)]
        for x in o[1:]:
            f.append(norm(f[-1] @ m.move * m.emit[x]))
        for x in o[:0:-1]:
            g.append(norm(m.move @ (m.emit[x] * g[-1])))
        g.reverse()
        for t, x in enumerate(o):
            e[x] += norm(f[t] * g[t])
            if t:
                w = f[t - 1][:, None] * m.move * (m.emit[x] * g[t])[None]
                a += w / w.sum()
        s += norm(f[0] * g[0])
    first = np.concatenate([np.arange(len(o)) == 0 for o in texts])
    emitted, moves, start, *_ = hmm.expected(np.concatenate(texts), first, m)
    assert np.allclose(emitted, e) and np.allclose(moves, a) and np.allclose(start, s)
