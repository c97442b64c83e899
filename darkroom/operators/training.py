"""Gradient descent whose sums are taken where the rows lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from darkroom.sources.scratch import materialize, owned, release

Model = TypeVar("Model")
#: Rows whose gradient a task takes at once.
ROWS = 4096


def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of a batch in double precision, lists of one length as matrices."""
    out = []
    for column in batch.columns:
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out.append(flat.reshape(batch.num_rows, -1))
        else:
            out.append(column.to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def summed(rows: DataFrame, model: Model, terms: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``terms(model, *columns)``, a vector of fixed length.

    A task adds its rows up and gives one vector; the driver adds those of the tasks, in their order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = terms(shared.value, *arrays(batch.slice(low, ROWS)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    found = [np.frombuffer(r["total"], dtype=np.float64) for r in rows.mapInArrow(run, "total binary").collect()]
    shared.destroy()
    return np.sum(found, axis=0)


@owned
def descend(rows: DataFrame, model: Model, terms: Callable[..., np.ndarray], step: Callable[[Model, np.ndarray, int], Model], epochs: int) -> Model:
    """``model`` after ``epochs`` steps on the sums over all of ``rows`` (numbers and lists of one length).

    The rows are written once and read by every epoch where they lie; what reaches the driver is a
    vector of the model's size a task, however many rows there are.
    """
    held = materialize(rows)
    count = held.count()
    if not count:
        raise ValueError("no training samples")
    for _ in range(epochs):
        model = step(model, summed(held, model, terms), count)
    release(held)
    return model
