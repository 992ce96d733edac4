"""Arrow helpers used inside grouped tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equal-length list column as a rows x length matrix."""
    values = column.combine_chunks()
    if len(values) == 0:
        return np.zeros((0, 0))
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def split_roles(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Donor rows and treated rows, both in unit order."""
    table = table.sort_by([("unit", "ascending")])
    role = table["role"]
    donors = table.filter(pc.equal(role, "control"))
    treated = table.filter(pc.equal(role, "treated"))
    return donors, treated


def recentred(X: np.ndarray, Y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both less the donors' median at each period. Weights sum to one, so no
    fit changes, and a donor far from the rest does not move the others."""
    level = np.median(X, axis=0)
    return X - level, Y - level
