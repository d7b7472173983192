"""Logging: everything to a file of the day, progress to the console; times of steps; counts observed while a job runs."""

from __future__ import annotations

import datetime as dt
import functools
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def configure(folder: str, name: str = "leafmill") -> logging.Logger:
    """A logger that writes all messages to ``folder``/DATE.log and INFO and above to the console; calling it again changes nothing."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        logger.setLevel(logging.DEBUG)
        for handler, level in ((logging.FileHandler(Path(folder) / f"{dt.date.today()}.log", encoding="utf-8"), logging.DEBUG), (logging.StreamHandler(), logging.INFO)):
            handler.setLevel(level)
            handler.setFormatter(logging.Formatter(_FORMAT))
            logger.addHandler(handler)
    return logger


@contextmanager
def step(logger: logging.Logger, name: str) -> Iterator[None]:
    """Logs the start, the end with its seconds, or the failure of what is done inside; failures go on."""
    began = time.perf_counter()
    logger.debug("%s: start", name)
    try:
        yield
    except Exception:
        logger.exception("%s: failed after %.1f s", name, time.perf_counter() - began)
        raise
    logger.info("%s: %.1f s", name, time.perf_counter() - began)


def logged(logger: logging.Logger) -> Callable:
    """Decorator form of :func:`step`."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **kw):
            with step(logger, f.__name__):
                return f(*args, **kw)

        return run

    return wrap


def observed(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Observation]:
    """``df`` with counts that Spark takes while the rows pass by: ``rows`` and the sums of the given conditions; no extra job."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.sum(c.cast("long")).alias(k) for k, c in counts.items()]), watch
