"""Dense kernels over a column of images, a batch at a time, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumidisc.session import ship


#: Small images that one numpy step works on.
BATCH_ROWS = 2000


def per_batch(images: DataFrame, work: Callable[[np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], schema: str, side: int) -> DataFrame:
    """images: image_id, levels. work: from (n, side, side) uint8 images to the image (0 to n - 1) of each result row and columns; image_id is put in front."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            stack = batch.column("levels").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(batch.num_rows, side, side)
            of, out = work(stack)
            yield pa.RecordBatch.from_pydict({"image_id": batch.column("image_id").cast(pa.int64()).take(pa.array(of)), **out})

    ship(images.sparkSession)
    return images.select("image_id", "levels").mapInArrow(each, f"image_id bigint, {schema}")


def per_image(images: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, side: int) -> DataFrame:
    """The same with work that takes one (side, side) image and gives columns of equal length."""

    def each(stack: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        parts = [work(image) for image in stack]
        n = [len(next(iter(p.values()))) for p in parts]
        return np.repeat(np.arange(len(stack)), n), {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return per_batch(images, each, schema, side)


def grids(values: np.ndarray, name: str = "v") -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Dense results, (n, height, width), as (row, col, value) columns."""
    of, row, col = np.indices(values.shape)
    return of.ravel(), {"row": row.ravel().astype(np.int32), "col": col.ravel().astype(np.int32), name: values.ravel().astype(np.int32)}


def grid(values: np.ndarray, name: str = "v") -> dict[str, np.ndarray]:
    """A dense result as (row, col, value) columns."""
    row, col = np.indices(values.shape)
    return {"row": row.ravel().astype(np.int32), "col": col.ravel().astype(np.int32), name: values.ravel().astype(np.int32)}
