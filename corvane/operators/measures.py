"""Scores by name: a table of metrics, and one function that adds those asked for.

A metric is a function of the column names of the predicted and the correct text that gives a column. ``semantic`` compares vectors; its texts
are embedded first by any function of a batch (``embedded``), or columns with vectors are there already. Names can be added with
``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import distances, graph
from corvane.operators import records

Metric = Callable[[str, str], Column]
METRICS: dict[str, Metric] = {
    "jaccard": distances.jaccard,
    "wer": distances.word_error_rate,
    "parts": distances.changed_parts,
    "edit": distances.edit,
    "graph_edit": graph.graph_edit,
    "ter": distances.ter,
    "chrf": distances.chrf,
}
NORMALISED = {"edit": "norm_edit", "graph_edit": "norm_graph_edit"}


def register(name: str, metric: Metric) -> None:
    """Adds a metric, or replaces one."""
    METRICS[name] = metric


def embedded(df: DataFrame, embed: Callable[[list[str]], np.ndarray], text: str, into: str) -> DataFrame:
    """Adds the vector of each text; ``embed`` maps a batch of texts to one row of numbers each. NULL stays NULL."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            there = texts.index[texts.notna()]
            if len(there):
                for i, v in zip(there, np.asarray(embed([texts[i] for i in there]), dtype=np.float32)):
                    out[i] = v
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, "array<float>")(F.col(text)))


def evaluated(df: DataFrame, metrics: list[str], normalize: bool = False, wer_max: bool = False, f: str = "f", fprime: str = "f_prime", vectors: tuple[str, str] | None = None) -> DataFrame:
    """Adds the scores named to every record that can be scored; the others get NULL.

    ``normalize`` gives instead, for ``edit`` and ``graph_edit``, the distance over the size of the correct formula's
    tokens or graph, with a distance that the record already has taken as it is; other metrics have no such form.
    ``wer_max`` cuts the word error rate at 1. ``semantic`` needs ``vectors``, the columns of both vectors. Unknown names raise ValueError.
    """
    unknown = [m for m in metrics if m not in METRICS and m != "semantic"]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known are {sorted([*METRICS, 'semantic'])}")
    scores: dict[str, Column] = {}
    for m in metrics:
        if normalize:
            if m in NORMALISED:
                given = F.coalesce(F.expr(f"try_cast(`{m}` as double)"), METRICS[m](f, fprime).cast("double")) if m in df.columns else METRICS[m](f, fprime)
                scores[NORMALISED[m]] = distances.norm_edit(given, fprime) if m == "edit" else given / F.nullif(graph.graph_size(fprime), F.lit(0))
        elif m == "semantic":
            if vectors is None:
                raise ValueError("semantic needs the columns of both vectors")
            scores[m] = F.when(F.col(f).isNotNull() & F.col(fprime).isNotNull(), distances.semantic(*vectors))
        else:
            score = METRICS[m](f, fprime)
            scores[m] = F.when(score.isNotNull(), F.least(F.lit(1.0), score)) if m == "wer" and wer_max else score
    return records.scored(df, scores, f, fprime)
