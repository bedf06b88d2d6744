"""The decompositions as table functions for SQL.

``SELECT * FROM emd(TABLE(signals) PARTITION BY series_id ORDER BY t)`` after :func:`register`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from . import kernels as K

_COLUMNS = "series_id bigint, component int, kind string, t int, value double, status string"


class _Decomposition:
    """Gathers a partition's batches of ``series_id, t, value`` and gives back the long frame of its parts."""

    parts = staticmethod(K.emd)
    whole = False

    def __init__(self):
        self.series, self.x = None, []

    def eval(self, batch: pa.RecordBatch):
        if len(batch):
            self.series = batch.column("series_id")[0].as_py()
            self.x.append(batch.column("value").to_numpy(zero_copy_only=False).astype(float))
        return iter(())

    def terminate(self):
        if not self.x:
            return
        x = np.concatenate(self.x)
        try:
            parts, status = self.parts(x), "ok"
        except K.SignalError as e:
            parts, status = [x] if self.whole and e.code == "convergence_failed" else [], e.code
        if not parts:
            yield pa.table(
                {
                    "series_id": pa.array([self.series], pa.int64()), "component": pa.array([None], pa.int32()), "kind": pa.array([None], pa.string()),
                    "t": pa.array([None], pa.int32()), "value": pa.array([None], pa.float64()), "status": [status],
                }
            )
        for c, part in enumerate(parts, 1):
            n = len(part)
            yield pa.table(
                {
                    "series_id": pa.array(np.full(n, self.series, np.int64)), "component": pa.array(np.full(n, c, np.int32)),
                    "kind": pa.array(["residue" if c == len(parts) else "imf"] * n), "t": pa.array(np.arange(n, dtype=np.int32)),
                    "value": pa.array(part), "status": pa.array([status] * n),
                }
            )


def register(spark: SparkSession, config: K.EmdConfig = K.EmdConfig(validate=False), vmd: K.VmdConfig = K.VmdConfig(), on_error: str = "status") -> None:
    """Makes ``emd`` and ``vmd`` known to SQL in this session.

    A series that fails is a row with its status; with ``whole`` as ``on_error`` one that does not
    converge is its own residue, and its status tells.
    """
    if on_error not in ("status", "whole"):
        raise ValueError("on_error is status or whole")

    class Emd(_Decomposition):
        parts = staticmethod(lambda x: K.emd(x, config))
        whole = on_error == "whole"

    class Vmd(_Decomposition):
        parts = staticmethod(lambda x: K.vmd(x, vmd))
        whole = on_error == "whole"

    spark.udtf.register("emd", arrow_udtf(Emd, returnType=_COLUMNS))
    spark.udtf.register("vmd", arrow_udtf(Vmd, returnType=_COLUMNS))
