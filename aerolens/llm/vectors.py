"""What the vector operators share: which vectors take part, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array of double) of rows with an id and a vector without null or non-finite parts, not all zero."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return kept.filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def arrow_matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of vectors of one length without nulls."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
