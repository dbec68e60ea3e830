"""The scores of languages are calibrated by all training texts."""

from __future__ import annotations

import random

import numpy as np

from tenderloom.llm import language


def test_all_texts_calibrate(spark):
    r = random.Random(1)
    words = {"en": ["the", "cat", "sat", "on", "a", "mat"], "de": ["der", "hund", "lag", "auf", "einer", "decke"]}
    texts = sorted({(" ".join(r.choice(words[k]) for _ in range(r.randint(2, 9))) + f" {i}", k) for i in range(700) for k in words})
    docs = spark.createDataFrame([*texts, *texts[:50], (None, "en"), ("12", "de"), ("no label", None)], "text string, lang string")
    for cells in (language.CELLS, 200):
        model = language.train(docs, cells=cells)
        if cells == language.CELLS:
            sums, n, letters = model.sums([t for t, _ in texts])
            e = np.asarray(sums) / np.maximum(n, 1)[:, None]
            best = e.argmin(axis=1)
            worst = [e[best == k, k].max() + 6 * e[best == k, k].std() + 1 for k in range(2)]
            gap, own = e - e.min(axis=1, keepdims=True), np.array([model.langs.index(k) for _, k in texts])
            loss = [np.mean(s * gap[np.arange(len(own)), own] + np.log(np.exp(-s * gap).sum(axis=1))) for s in language._SHARPNESS]
        assert np.allclose(model.worst, worst, atol=1e-5) and model.sharpness == language._SHARPNESS[int(np.argmin(loss))]
