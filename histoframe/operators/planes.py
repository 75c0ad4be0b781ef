"""The pixels of a tile's row as an array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PLANE = ["image_id", "channel_idx"]


def plane_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.dtype(row["dtype"]).newbyteorder("<")).reshape(row["h"], row["w"])


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one after the other, so that no more than one tile of it is copied at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]
