"""Schemas and the fixed vocabulary of the planning data model.

The long metric fact is one number per (entity keys, scenario, period, metric).
Grids are (entity keys, output, x, y, value) with decimal axes so that axis
equality is exact.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: scenario and metric names used by the analyses ---------
SCENARIOS = ("Low", "Base", "High")

FLEET = "Fleet Size (vehicles)"
RIDES = "Total Rides"
REVENUE = "Revenue (Net)"
VARIABLE_COSTS = "Variable Costs"
CONTRIBUTION_MARGIN = "Contribution Margin"
CM_PCT = "Contribution Margin %"
VEHICLE_FIXED = "Vehicle Fixed Costs (Total)"
PLATFORM_OVERHEAD = "Platform Overhead"
TOTAL_FIXED = "Total Fixed Costs"
EBITDA = "EBITDA"
EBITDA_PCT = "EBITDA Margin %"

METRICS = (
    FLEET,
    RIDES,
    REVENUE,
    VARIABLE_COSTS,
    CONTRIBUTION_MARGIN,
    CM_PCT,
    VEHICLE_FIXED,
    PLATFORM_OVERHEAD,
    TOTAL_FIXED,
    EBITDA,
    EBITDA_PCT,
)

# Grid outputs
OUT_REVENUE = "FY_Net_Revenue"
OUT_MARGIN = "FY_EBITDA_Margin"

# Axis type for sensitivity grids: exact equality on axis levels.
AXIS = T.DecimalType(9, 4)

FACT = T.StructType(
    [
        T.StructField("scenario", T.StringType()),
        T.StructField("month_number", T.IntegerType()),
        T.StructField("month", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

TOTALS = T.StructType(
    [
        T.StructField("scenario", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("fy_total", T.DoubleType()),
    ]
)

ASSUMPTIONS = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("driver_name", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("base_case", T.StringType()),
        T.StructField("low_case", T.StringType()),
        T.StructField("high_case", T.StringType()),
        T.StructField("active_value", T.StringType()),
    ]
)

GRID = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("x", AXIS),
        T.StructField("y", AXIS),
        T.StructField("value", T.DoubleType()),
    ]
)

def with_keys(schema: T.StructType, keys: dict[str, T.DataType]) -> T.StructType:
    """Prefix entity key columns to a schema."""
    return T.StructType([T.StructField(k, t) for k, t in keys.items()] + list(schema.fields))
