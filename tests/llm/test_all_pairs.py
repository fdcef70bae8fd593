"""op4 is fitted on all preference pairs."""

import numpy as np

from codeloom.llm import quality_classifier as Q


def test_gradient_over_all_pairs_vanishes(monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(90, Q.FEATURES))
    good = x[:, 0] + draw.normal(size=90) > 0
    for at_once in (Q.PAIRS_AT_ONCE, 100):
        monkeypatch.setattr(Q, "PAIRS_AT_ONCE", at_once)
        model = Q.fit_ranking(x, good)
        z = (x - model["mean"]) / model["spread"]
        d = np.array([a - b for a in z[good] for b in z[~good]])
        grad = -(d / (1 + np.exp(d @ model["w"]))[:, None]).mean(axis=0) + 1e-3 * model["w"]
        assert np.abs(grad).max() < 1e-6
