"""How the settings of the toxicity operator are chosen: by cross-validation inside the rows that may be learned from.

Held-out labels have no part in it. `python -m ledgerloom.llm.toxicity_settings FOLDER` prints, for the
settings in use and for each of OTHERS in place of them, how many toxic texts are found and how many clean ones are called
toxic, each fold scored by a model of the other folds.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np
import pandas as pd

from ledgerloom.llm import toxicity
from ledgerloom.llm.common import table

FOLDS = 3
OTHERS = ({"MIN_LIFT": 1.5}, {"MIN_LIFT": 2.0}, {"MIN_LIFT": 4.0}, {"MIN_LIFT": 5.0}, {"DECAY": 1e-3}, {"DECAY": 1e-2}, {"MIN_SHARE": 0.01}, {"MIN_SHARE": 0.04}, {"MAX_BALANCE": 8.0}, {"WIDTH": 16})


def scores(model: toxicity.Model, texts: list[str]) -> np.ndarray:
    logits = np.asarray([toxicity.worst(*model.word_scores(words)) if (words := toxicity.tokens(t)) else 0.0 for t in texts]) + model.bias
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def cross_validated(sample: pd.DataFrame, folds: int = FOLDS, **settings: float) -> dict[str, float]:
    """Share of toxic texts found and of clean ones called toxic, over all folds. sample: doc_id, text, toxic; a fold goes by a checksum of the id."""
    before = {name: getattr(toxicity, name) for name in settings}
    fold = np.asarray([crc32(b"fold%d" % d) % folds for d in sample["doc_id"]])
    label, found = sample["toxic"].to_numpy(np.int64), np.zeros(len(sample), bool)
    try:
        for name, value in settings.items():
            setattr(toxicity, name, value)
        for k in range(folds):
            model = toxicity.train(sample["text"][fold != k].tolist(), label[fold != k])
            found[fold == k] = scores(model, sample["text"][fold == k].tolist()) >= toxicity.THRESHOLD
    finally:
        for name, value in before.items():
            setattr(toxicity, name, value)
    return {"toxic": int((label == 1).sum()), "found": float(found[label == 1].mean()), "clean": int((label == 0).sum()), "called": float(found[label == 0].mean())}


def main(folder: str) -> None:
    from ledgerloom.session import local_session

    spark = local_session("8", 8, "settings")
    sample = toxicity.labelled_sample(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    for settings in ({}, *OTHERS):
        print(settings, {k: round(v, 4) for k, v in cross_validated(sample, **settings).items()}, flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
