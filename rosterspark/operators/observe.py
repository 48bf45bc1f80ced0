"""Progress observers (F3) without extra scans.

``with_progress_metrics`` attaches a named ``Observation`` to a frame: the
counts are computed by the same job that consumes the frame and read back on
the driver afterwards (a few numbers, not data).  For streams,
``ProgressListener`` forwards each micro-batch's progress to callbacks; a
failing callback is isolated from the others and from the query.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def with_progress_metrics(validated: DataFrame, name: str = "validation"):
    """Return ``(frame, observation)``; ``observation.get`` holds processed / valid / invalid after an action."""
    obs = Observation(name)
    out = validated.observe(
        obs,
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("is_valid")).alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
    )
    return out, obs


class ProgressListener(StreamingQueryListener):
    """F3 for streams: typed handlers called with each query's progress; errors in a handler are isolated."""

    def __init__(self, on_progress: list[Callable] | None = None, on_terminated: list[Callable] | None = None):
        self.on_progress = list(on_progress or [])
        self.on_terminated = list(on_terminated or [])
        self.errors: list = []

    def _call(self, handlers, arg):
        for h in handlers:
            try:
                h(arg)
            except Exception as exc:  # noqa: BLE001 - one failing observer must not stop the others
                self.errors.append(exc)

    def onQueryStarted(self, event):  # noqa: N802 - Spark's listener API
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self._call(self.on_progress, {"batch_id": p.batchId, "rows": p.numInputRows, "name": p.name,
                                      "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self._call(self.on_terminated, {"id": str(event.id), "exception": event.exception})
