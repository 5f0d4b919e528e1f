"""Imports every query module so that the registry is complete."""

from marketflow.plans import queries_basic  # noqa: F401
from marketflow.plans import queries_stats  # noqa: F401
from marketflow.plans import queries_series  # noqa: F401
from marketflow.plans import queries_models  # noqa: F401
from marketflow.plans import queries_stream  # noqa: F401
from marketflow.plans import queries_stack  # noqa: F401
from marketflow.plans import queries_purge  # noqa: F401
from marketflow.plans import queries_rolling  # noqa: F401
from marketflow.plans import queries_correlate  # noqa: F401
from marketflow.plans import queries_quantiles  # noqa: F401
