"""Telemetry and profile analytics on Spark DataFrames.

Every operator is ``DataFrame -> DataFrame`` and lazy.  Tables follow
``hostpulse.schemas``; every partition key starts with ``host``.
"""

__version__ = "0.1.0"
