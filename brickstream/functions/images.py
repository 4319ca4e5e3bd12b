"""Perceptual hash of image bytes; needs Pillow, which may be absent."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from PIL import Image
except ImportError:  # the engine works without images
    Image = None


def dct_hash(grey: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits: signs of the low cosine frequencies of a 32 x 32 image against their median."""
    n = grey.shape[0]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ grey.astype(float) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def decode(content: bytes) -> np.ndarray | None:
    if Image is None or not content:
        return None
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("L").resize((32, 32)))
    except OSError:
        return None


@F.pandas_udf(T.StringType())
def _hashes(contents: pd.Series) -> pd.Series:
    return pd.Series([None if (g := decode(c)) is None else dct_hash(g) for c in contents], dtype=object)


def perceptual_hash(content: Column) -> Column:
    """Hash of image bytes; null for what can't be read (and everywhere without Pillow)."""
    return _hashes(content)
