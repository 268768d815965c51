from scenaria.functions.columns import (  # noqa: F401
    adaptive_round,
    exact_running_sum,
    linear_crossing,
    pct_change,
    round_by_output,
    safe_div,
)
