"""Where a model comes in: a scorer that supplies logits and scores as columns.

A scorer embeds an image once and answers all its prompts; ``score_prompts`` brings the prompts of an image
together and streams them through one scorer a worker. Everything behind it works on the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from slicewright.session import share_package


class Scorer(Protocol):
    def embed(self, image: Any) -> Any:
        """What the model needs of an image, whatever the prompts."""

    def predict(self, embedding: Any, box: list[float]) -> list[tuple[np.ndarray, float]]:
        """(logits, score) of each candidate for a box."""


def score_prompts(prompts: DataFrame, factory: Callable[[], Scorer], image_key: str, instance_key: str, image: str, box: str) -> DataFrame:
    """image_key, instance_key, candidate_index, logits (flat), h, w, model_score.

    ``factory`` makes the scorer on each worker's task. Prompts of one image come one after the other, sorted, so
    an image is embedded once, and no image's prompts are held together. A null box gives no candidates.
    """
    share_package(prompts.sparkSession)
    kinds = {f: prompts.schema[f].dataType.simpleString() for f in (image_key, instance_key)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, now, embedding = None, object(), None
        for pdf in batches:
            rows = []
            for key, instance, picture, b in zip(pdf["_key"], pdf["_instance"], pdf["_image"], pdf["_box"]):
                if b is None:
                    continue
                if scorer is None:
                    scorer = factory()
                if key != now:
                    now, embedding = key, scorer.embed(picture)
                for k, (logits, score) in enumerate(scorer.predict(embedding, list(b))):
                    rows.append((key, instance, k, np.asarray(logits, np.float32).ravel().tolist(), *logits.shape, float(score)))
            yield pd.DataFrame(rows, columns=[image_key, instance_key, "candidate_index", "logits", "h", "w", "model_score"])

    picked = prompts.selectExpr(f"{image_key} AS _key", f"{instance_key} AS _instance", f"{image} AS _image", f"{box} AS _box")
    ordered = picked.repartition("_key").sortWithinPartitions("_key", "_instance")
    return ordered.mapInPandas(run, f"{image_key} {kinds[image_key]}, {instance_key} {kinds[instance_key]}, candidate_index int, logits array<float>, h int, w int, model_score double")
