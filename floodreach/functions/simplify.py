"""Line simplification, the one geometry step with no built-in equivalent."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _keep(xy: np.ndarray, tol: float) -> np.ndarray:
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        seg, rel = xy[j] - xy[i], xy[i + 1:j] - xy[i]
        l2 = float(seg @ seg)
        t = np.clip(rel @ seg / l2, 0, 1) if l2 else np.zeros(len(rel))
        d = np.hypot(*(rel - t[:, None] * seg).T)
        k = int(d.argmax())
        if d[k] > tol:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify(line, tolerance_m: float):
    """Douglas-Peucker, as an Arrow-batched function of one line column. Coordinates travel as two plain arrays, not as an object per vertex."""
    @F.pandas_udf("x array<double>, y array<double>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        def one(x, y):
            if x is None or len(x) < 3:
                return x, y
            keep = _keep(np.column_stack([x, y]).astype(float), tolerance_m)
            return x[keep], y[keep]
        kept = [one(x, y) for x, y in zip(xs, ys)]
        return pd.DataFrame({"x": [k[0] for k in kept], "y": [k[1] for k in kept]}, dtype=object)

    kept = run(F.transform(line, lambda q: q["x"].cast("double")), F.transform(line, lambda q: q["y"].cast("double")))
    return F.zip_with(kept["x"], kept["y"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
