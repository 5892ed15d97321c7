"""Options of a session, under spark.foliospark.*: knobs are clamped into their range, ceilings are refused when unreadable."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import SparkSession

PREFIX = "spark.foliospark."
#: Knob -> (default, least, greatest, whole number).
KNOBS = {
    "safety_margin": (0.1, 0, 0.5, False), "min_output_tokens": (256, 0, 10**6, True), "max_retries": (3, 0, 10, True),
    "retry_pause_base": (1.0, 0, 60, False), "request_timeout": (120.0, 1, 3600, False), "workers": (4, 1, 32, True),
}
#: Ceiling -> (default, least, whole number); None is no ceiling.
CEILINGS = {"max_cost_usd": (5.0, 0, False), "max_calls": (400, 0, True), "max_tokens_total": (None, 0, True), "max_output_tokens": (None, 1, True)}


def _number(value: object) -> float | None:
    try:
        out = float(str(value))
    except ValueError:
        return None
    return None if math.isnan(out) else out


def set_option(spark: SparkSession, name: str, value: object) -> None:
    """Set one option. A knob that cannot be read keeps its value, with a warning; a ceiling that cannot be read is an
    error, for any other value would be a limit nobody chose. None and infinity mean no ceiling."""
    if name in KNOBS:
        _, low, high, whole = KNOBS[name]
        number = _number(value)
        if number is None or math.isinf(number):
            warnings.warn(f"{name} = {value!r} is no number; it stays {option(spark, name)}", stacklevel=2)
            return
        number = min(max(number, low), high)
        spark.conf.set(PREFIX + name, str(int(number) if whole else number))
    elif name in CEILINGS:
        _, low, whole = CEILINGS[name]
        number = math.inf if value is None else _number(value)
        if number is None or number < low:
            raise ValueError(f"{name} = {value!r} is no limit; give a number of {low} or more, or None")
        spark.conf.set(PREFIX + name, "none" if math.isinf(number) else str(int(number) if whole else number))
    else:
        raise KeyError(f"no option {name!r}; there are {', '.join([*KNOBS, *CEILINGS])}")


def option(spark: SparkSession, name: str) -> float | int | None:
    """The option's value; its default where the session has none."""
    default, whole = (KNOBS[name][0], KNOBS[name][3]) if name in KNOBS else (CEILINGS[name][0], CEILINGS[name][2])
    said = spark.conf.get(PREFIX + name, None)
    if said is None:
        return default
    return None if said == "none" else int(float(said)) if whole else float(said)


def governor(spark: SparkSession):
    """The limits that the session's ceilings set."""
    from foliospark.operators.model import Governor

    return Governor(**{name: option(spark, name) for name in CEILINGS}, margin=option(spark, "safety_margin"))
