"""Sending functions to Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value: executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
