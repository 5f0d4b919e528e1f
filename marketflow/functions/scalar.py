"""Scalar column functions (FN1-FN9, PRJ3, PRJ5, PRJ6, MOD5).

Everything is a built-in expression: ANSI-safe (``try_cast``, ``try_divide``),
null-preserving, inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """FN1 division: NULL instead of an ANSI error / inf on a zero denominator."""
    return F.try_divide(col(a), col(b))


def to_double(c) -> Column:
    """PRJ3 non-strict cast: unparsable -> NULL, bool -> 1.0/0.0, NaN -> NULL."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def clip(x, lo: float, hi: float) -> Column:
    """FN2: clip into [lo, hi], NULL stays NULL (``greatest`` alone would turn
    NULL into ``lo``)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def u1(i2="I2", i1="I1") -> Column:
    """PRJ5: U1 = I2 - I1."""
    return col(i2) - col(i1)


def u2(m11="M11", i2="I2", i9="I9", i7="I7") -> Column:
    """PRJ6: U2 = M11 / ((I2 + I9 + I7) / 3); zero denominator -> NULL."""
    return safe_div(col(m11), (col(i2) + col(i9) + col(i7)) / 3)


def fmt(x, decimals: int = 6) -> Column:
    """FN5: fixed-decimal text, as ``f'{x:.6f}'``."""
    return F.format_string(f"%.{decimals}f", col(x))


def log_grid_values(n: int = 100, lo_exp: float = -4.0, hi_exp: float = 2.0) -> list[float]:
    """FN9: ``n`` log-spaced values 10**lo_exp .. 10**hi_exp."""
    step = (hi_exp - lo_exp) / (n - 1) if n > 1 else 0.0
    return [10.0 ** (lo_exp + i * step) for i in range(n)]


# --------------------------------------------------------------- signal (MOD5)

# The position-signal bounds and multiplier.
MIN_SIGNAL = 0.0
MAX_SIGNAL = 2.0
SIGNAL_MULTIPLIER = 400.0


@dataclass(frozen=True)
class SignalParams:
    signal_multiplier: float = SIGNAL_MULTIPLIER
    min_signal: float = MIN_SIGNAL
    max_signal: float = MAX_SIGNAL


def ret_to_signal(pred, params: SignalParams = SignalParams()) -> Column:
    """MOD5: clip(pred * multiplier + 1, min, max)."""
    return clip(col(pred) * F.lit(params.signal_multiplier) + F.lit(1.0), params.min_signal, params.max_signal)


# ------------------------------------------------- error classification (FN8)

def classify_error(message, endpoint: str = "predict") -> tuple[Column, Column]:
    """FN8: (error_type, details) of a server error message, tested in order:
    never started (1), missing endpoint (4), raised exception (3, with the
    inner message extracted case-insensitively), otherwise unclassified (NULL).
    """
    m = col(message)
    never = m.contains("Failed to connect to server after waiting")
    missing = m.contains(f"No listener for {endpoint} was registered")
    raised = m.contains("Exception calling application")
    inner = F.regexp_extract(m, r'(?i)"Exception calling application: (.*)"', 1)
    etype = (F.when(never, F.lit(1)).when(missing, F.lit(4)).when(raised, F.lit(3)))
    details = (F.when(never, F.lit(None).cast("string"))
               .when(missing, F.lit(f"Server did not register a listener for {endpoint}"))
               .when(raised, F.when(inner != "", inner).otherwise(m))
               .otherwise(m))
    return etype.cast("int"), details
