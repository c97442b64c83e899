"""Embeddings of images by an ONNX encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from darkroom.functions.imaging import colours, resize

# Size, mean and spread of what the encoder was trained on.
EDGE = 224
MEAN = np.array([0.48145466, 0.4578275, 0.40821073])
SPREAD = np.array([0.26862954, 0.26130258, 0.27577711])
Model = Callable[[np.ndarray], np.ndarray]


def encoder_input(rgb: np.ndarray) -> np.ndarray:
    """(3, 224, 224) values of an image (height, width, 3) of 0 to 255."""
    planes = np.stack([resize(rgb[:, :, c], EDGE, EDGE) for c in range(3)])
    return ((planes / 255 - MEAN[:, None, None]) / SPREAD[:, None, None]).astype(np.float32)


def open_onnx(path: str) -> Model:
    """The first output of a model file for a batch of inputs, on one thread."""
    from onnxruntime import InferenceSession, SessionOptions

    options = SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = InferenceSession(path, options, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda batch: session.run(None, {name: batch})[0]


def embeddings(pictures: DataFrame, path: str, opener: Callable[[str], Model] = open_onnx, rows: int = 16) -> DataFrame:
    """(sha256, embedding, error) of pictures (sha256, image): unit vectors by the model at ``path``.

    The path is one that all executors read; a task opens the model once and encodes ``rows`` images
    at a time.  Files that do not decode get an error and a null embedding.
    """

    def run(batches):
        model = None
        for batch in batches:
            for low in range(0, len(batch), rows):
                some = batch.iloc[low : low + rows]
                inputs, errors = [], []
                for image in some.image:
                    try:
                        inputs.append(encoder_input(colours(image).astype(float)))
                        errors.append(None)
                    except ValueError as error:  # one bad file does not stop the rest
                        errors.append(str(error))
                vectors = iter(())
                if inputs:
                    model = model or opener(path)
                    found = np.asarray(model(np.stack(inputs)), dtype=np.float64).reshape(len(inputs), -1)
                    length = np.linalg.norm(found, axis=1, keepdims=True)
                    vectors = iter(np.where(length > 1e-6, found / np.maximum(length, 1e-6), found).astype(np.float32))
                out = [None if e else next(vectors) for e in errors]
                yield pd.DataFrame({"sha256": some.sha256.to_numpy(), "embedding": out, "error": errors})

    return pictures.select("sha256", "image").mapInPandas(run, "sha256 string, embedding array<float>, error string")
