"""Large expressions are built once per application.

Building an expression of a few thousand nodes crosses the Python to JVM bridge
once per node; the built Column does not depend on any DataFrame.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import SparkSession


def reuse(build):
    """Keep what `build(*names)` returns for as long as the application runs."""
    kept = {}

    @wraps(build)
    def get(*names):
        session = SparkSession.getActiveSession()
        if session is None:
            return build(*names)
        key = (session.sparkContext.applicationId, names)
        if key not in kept:
            kept[key] = build(*names)
        return kept[key]

    return get
