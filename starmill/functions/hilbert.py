"""Hilbert curve codes in any number of dimensions (Skilling 2004, AIP Conf. Proc. 707, 381)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_np(axes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of the rows of ``axes`` (integers below 2**bits); dims * bits must be below 64."""
    x = np.array(axes, dtype=np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("a code has to fit 63 bits")
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            odd = (x[d] & q) != 0
            swap = np.where(odd, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(odd, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    code = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            code = (code << 1) | ((x[d] >> b) & 1)
    return code


def hilbert(bits: int, *axes: Column) -> Column:
    """Code of integer columns in 0..2**bits - 1; nulls count as 0, other values are cut to the range."""

    @F.pandas_udf("bigint")
    def code(t: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_np(t.fillna(0).to_numpy(np.int64).clip(0, (1 << bits) - 1), bits))

    return code(F.struct(*[a.cast("bigint").alias(f"a{k}") for k, a in enumerate(axes)]))
