"""marketflow: forecasting toolkit for wide daily time-series tables on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or returns a
small fitted-parameter DataFrame / frozen dataclass). Heavy work stays on the
executors; the driver only handles column-name metadata and bounded
one-row/one-row-per-bucket results.
"""

from marketflow.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
