"""Registry of oracle SQL strings, keyed like ``catalog.QUERIES``."""

from __future__ import annotations

from scenaria.plans import oracle as O

ORACLE: dict[str, str] = {
    "scenario_spread": O.scenario_spread(),
    "zero_crossings": O.zero_crossings(),
    "operating_leverage": O.operating_leverage(),
    "volume_price_mix": O.volume_price_mix(),
    "cumulative_payback": O.cumulative_payback(),
    "growth_overtake": O.growth_overtake(),
    "unit_economics": O.unit_economics(),
    "margin_of_safety": O.margin_of_safety(),
    "grid_sensitivity": O.grid_sensitivity(),
    "lever_ranking": O.lever_ranking(),
    "interaction_effects": O.interaction_effects(),
    "flow_trace": O.flow_trace(),
    "weighted_expectation": O.weighted_expectation(),
    "weighted_by_lines": O.weighted_by_lines(),
    "reconcile": O.reconcile(),
    "grid_audit": O.grid_audit(),
    "kpi_totals": O.kpi_totals(),
    "sensitivity_matrix": O.sensitivity_matrix(),
    "flatten_grid": O.flatten_grid(),
    "cost_structure": O.cost_structure(),
    "margin_trajectory": O.margin_trajectory(),
    "unpivot_fact": O.unpivot_fact(),
    "load_audit": O.load_audit(),
    "load_assumptions": O.load_assumptions(),
    "load_pl": O.load_pl(),
    "load_fy_totals": O.load_fy_totals(),
    "payback_first": O.payback_first(),
    "reconcile_strict": O.reconcile_strict(),
    "grid_vs_totals": O.grid_vs_totals(),
    "duplicate_lines": O.duplicate_lines(),
    "load_grid_blocks": O.load_grid_blocks(),
    "load_titled": O.load_titled(),
    "load_csv": O.load_csv(),
    "csv_audit": O.csv_audit(),
    "reload_scenario": O.reload_scenario(),
    "load_counts": O.load_counts(),
    "bucketed_reconcile": O.reconcile(),
    "load_engines": O.load_engines(),
    "replanned_grid": O.replanned_grid(),
    "replanned_vs_totals": O.replanned_vs_totals(),
    "gap_crossings": O.gap_crossings(),
    "filled_gaps": O.filled_gaps(),
    "grid_cells_check": O.grid_cells_check(),
}
