"""A group of vectors sorts the hits of those queries only that gain by it."""

import numpy as np

from lectern.operators import retrieval


def test_hits_are_not_sorted_anew_for_each_group(monkeypatch):
    draw = np.random.default_rng(7)
    vectors, queries, k = draw.standard_normal((4000, 16)), draw.standard_normal((400, 16)), 5
    ids, entries, real = draw.permutation(4000), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (entries.append(len(keys[0])), real(keys))[1])
    best = retrieval.NearestSoFar(queries, k, "l2")
    for start in range(0, 4000, 500):
        best.show(vectors[start:start + 500], ids[start:start + 500])
    assert sum(entries) < 20 * len(queries) * k
    far = ((queries[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)
    for q in range(len(queries)):
        want = sorted(zip(far[q].round(10), ids.tolist()))[:k]
        own = best.at == q
        assert list(zip(best.distances[own].round(10), best.ids[own].tolist())) == want
