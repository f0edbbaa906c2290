"""Frames for Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd


def frame(**columns) -> pd.DataFrame:
    """A frame whose columns are numeric arrays or plain objects, also where it has no rows.

    String columns of pandas are kept in chunks, which the transfer to Spark takes for nested types
    when they are empty; plain objects are converted by the declared schema instead.
    """
    return pd.DataFrame({k: v if isinstance(v, np.ndarray) and v.dtype.kind in "biuf" else pd.Series(list(v), dtype=object) for k, v in columns.items()})
