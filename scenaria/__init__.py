"""scenaria: scenario and sensitivity analytics on Spark DataFrames.

Every operator is a lazy ``DataFrame -> DataFrame`` transform written with
built-in ``pyspark.sql.functions``; nothing is collected to the driver.

Layout
------
functions/  Column -> Column helpers (safe division, growth, rounding, interpolation)
sources/    table readers, marts derived from the warehouse tables, reshape steps, sinks
operators/  pivot, time-series, grid, portfolio and audit operators
plans/      the named analyses (driver queries) and their SQL oracles
streaming/  micro-batch audit of newly landed fact snapshots
"""

from scenaria.schema import METRICS, SCENARIOS  # noqa: F401

__all__ = ["METRICS", "SCENARIOS"]
