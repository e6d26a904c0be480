"""Fitting a model once, in one task, on a sample of stated size."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark.sql import DataFrame


def fit(sample: DataFrame, learn: Callable):
    """``learn(rows)`` over the sample's rows, run in one task; returns the model.

    Only for samples with a bound on their size. The rows reach ``learn`` as an
    iterator of Arrow batches, in a fixed order (by the first column).
    """
    import pyarrow as pa

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(batches))], pa.binary())], ["model"])

    ordered = sample.repartition(1).sortWithinPartitions(sample.columns[0])
    row = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else learn(iter(()))
