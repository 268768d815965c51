"""Reshape steps that turn sheet-shaped exports into the planning tables.

Input sheets arrive as rows ``(sheet, row_no, c0 .. cN)`` of text cells. The
steps are narrow transforms (no shuffle) except the final write: section
slicing by row ranges, positional renaming, dropping empty / decorative /
repeated-header rows, melting period columns into a long fact, turning a
matrix block into a long grid, and stacking per-scenario snapshots.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria import schema as S

# Fixed value: prefix of decorative divider rows in the sheets.
DIVIDER = "──"


def slice_sections(
    raw: DataFrame, sections: Sequence[tuple[str, int, int]], sheet: str | Sequence[str] | None = None, row_col: str = "row_no"
) -> DataFrame:
    """Tag rows of the named sheet(s) with the section whose half-open row range ``[lo, hi)`` contains them; drop the rest.

    The section list is a literal of a few entries, compiled into one CASE
    expression: no join, no shuffle. ``sheet=None`` takes rows of any sheet.
    """
    if sheet is not None:
        raw = raw.where(F.col("sheet").isin([sheet] if isinstance(sheet, str) else list(sheet)))
    r = F.col(row_col)
    tag: Column | None = None
    for name, lo, hi in sections:
        cond = (r >= F.lit(lo)) & (r < F.lit(hi))
        tag = F.when(cond, F.lit(name)) if tag is None else tag.when(cond, F.lit(name))
    return raw.withColumn("section", tag).where(F.col("section").isNotNull())


def data_columns(df: DataFrame, n: int | None = None) -> list[str]:
    """The data columns c0, c1, ... in order, or the first ``n`` of them."""
    cols = sorted((c for c in df.columns if c.startswith("c") and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return cols if n is None else cols[:n]


def rename_positional(df: DataFrame, names: Sequence[str], source_cols: Sequence[str] | None = None) -> DataFrame:
    """Give the data columns new names by position; as many names as columns, or it is an error.

    ``source_cols`` picks the columns to rename (default: all data columns); other data columns go.
    """
    cols = list(source_cols) if source_cols is not None else data_columns(df)
    if len(cols) != len(names):
        raise ValueError(f"{len(names)} names for {len(cols)} columns")
    keep = [c for c in df.columns if c not in data_columns(df) and c not in cols]
    return df.select(*keep, *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])


def clean_rows(df: DataFrame, key: str, drop_dividers: bool = True, header: str | None = None) -> DataFrame:
    """Drop rows with a NULL key, divider rows (``'──…'``) and repeated header rows (key == header)."""
    k = F.col(key)
    cond = k.isNotNull()
    if drop_dividers:
        cond = cond & ~k.startswith(DIVIDER)
    if header is not None:
        cond = cond & (k != F.lit(header))
    return df.where(cond)


def melt_periods(
    df: DataFrame,
    ids: Sequence[str],
    period_cols: Sequence[str],
    label_col: str = "month",
    value_col: str = "value",
    number_col: str = "month_number",
    label_prefix: str = "Month_",
) -> DataFrame:
    """Wide period columns -> long rows, with the period number parsed from the label.

    ``unpivot`` plans one ``Expand`` node (no shuffle). NULL cells are kept.
    """
    long = df.unpivot(list(ids), list(period_cols), label_col, value_col)
    num = F.regexp_replace(F.col(label_col), F.lit(label_prefix), F.lit("")).try_cast("int")
    return long.withColumn(number_col, num)


def matrix_to_long(
    matrix: DataFrame,
    row_axis: str,
    level_cols: Mapping[str, float],
    output: str,
    table: str,
    keys: Iterable[str] = (),
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """A matrix block (rows = axis A levels, one column per axis B level) -> long grid rows.

    ``level_cols`` maps each matrix column to its axis-B level; the row axis
    column supplies axis A. Output: ``(keys, table, output, x, y, value)``.
    """
    keys = list(keys)
    cells = F.array(
        *[F.struct(F.lit(str(lv)).cast(S.AXIS).alias(y), F.col(c).cast("double").alias("value")) for c, lv in level_cols.items()]
    )
    return matrix.select(
        *keys,
        F.lit(table).alias("table"),
        F.lit(output).alias("output"),
        F.col(row_axis).cast("string").cast(S.AXIS).alias(x),
        F.inline(cells),
    ).select(*keys, "table", "output", x, y, "value")


def cells_to_grid(cells: DataFrame, outputs: Mapping[str, tuple[str, str]], keys: Iterable[str] = ()) -> DataFrame:
    """Matrix sheets as cells (keys..., sheet, row_no, col_no, cell) -> long grid rows.

    Axis levels are read from the sheet: row 0 holds the levels of y, column 0 those of x, however many
    there are. ``outputs`` maps a sheet to its (table, output). A blank cell gives a NULL value.
    """
    keys = list(keys)
    part = [*keys, "sheet"]
    row_no, col_no, cell = F.col("row_no"), F.col("col_no"), F.col("cell")
    placed = cells.where(F.col("sheet").isin(list(outputs))).select(
        *part,
        row_no,
        col_no,
        cell,
        F.max(F.when(col_no == 0, cell)).over(Window.partitionBy(*part, "row_no")).alias("x"),
        F.max(F.when(row_no == 0, cell)).over(Window.partitionBy(*part, "col_no")).alias("y"),
    )

    def of(i: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for s, o in outputs.items() for v in (s, o[i])]), F.col("sheet"))

    return placed.where((row_no > 0) & (col_no > 0)).select(
        *keys,
        of(0).alias("table"),
        of(1).alias("output"),
        F.col("x").cast(S.AXIS).alias("x"),
        F.col("y").cast(S.AXIS).alias("y"),
        cell.try_cast("double").alias("value"),
    )


def stack_scenarios(snapshots: Mapping[str, DataFrame], scenario_col: str = "scenario") -> DataFrame:
    """Tag each per-scenario snapshot with its scenario and union them by column name."""
    out = None
    for name, df in snapshots.items():
        t = df.withColumn(scenario_col, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def tag_snapshots(df: DataFrame, scenario_of: Mapping[str, str], snapshot_col: str = "sheet") -> DataFrame:
    """Stacked snapshots in one table: the scenario of each row from its snapshot's name; other rows go."""
    names = F.create_map(*[F.lit(v) for kv in scenario_of.items() for v in kv])
    return df.withColumn("scenario", F.element_at(names, F.col(snapshot_col))).where(F.col("scenario").isNotNull())


def assumptions_from_sheet(
    raw: DataFrame, sections: Sequence[tuple[str, int, int]], sheet: str | None = None, keys: Iterable[str] = ()
) -> DataFrame:
    """Driver table from an assumptions sheet: slice, rename, clean, tag section."""
    names = ["driver_name", "unit", "base_case", "low_case", "high_case", "active_value"]
    t = slice_sections(raw, sections, sheet)
    t = rename_positional(t, names, data_columns(t, len(names)))
    t = clean_rows(t, "driver_name", drop_dividers=False)
    return t.select(*keys, "section", *names)


def engine_from_sheet(
    raw: DataFrame, lo: int, hi: int, drop_dividers: bool = True, sheet: str | None = None, keys: Iterable[str] = ()
) -> DataFrame:
    """Engine step table ``(metric, unit, definition, value)`` from a row range of a sheet."""
    names = ["metric", "unit", "definition", "value"]
    t = slice_sections(raw, [("engine", lo, hi)], sheet)
    t = rename_positional(t, names, data_columns(t, len(names)))
    t = clean_rows(t, "metric", drop_dividers=drop_dividers, header="Metric")
    return t.select(*keys, *names)


def pl_from_sheet(
    raw: DataFrame,
    lo: int,
    hi: int,
    metrics: Iterable[str],
    periods: int = 12,
    sheet: str | Sequence[str] | None = None,
    keys: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """P&L block -> (long fact rows, yearly totals) for the listed metrics, with the key columns."""
    keys = list(keys)
    months = [f"Month_{i}" for i in range(1, periods + 1)]
    names = ["metric", *months, "FY_Total"]
    t = slice_sections(raw, [("pl", lo, hi)], sheet)
    t = rename_positional(t, names, data_columns(t, len(names)))
    t = clean_rows(t, "metric", header="Metric").where(F.col("metric").isin(list(metrics)))
    t = t.select(
        *keys, "metric", *[F.col(m).try_cast("double").alias(m) for m in months], F.col("FY_Total").try_cast("double").alias("fy_total")
    )
    long = melt_periods(t, [*keys, "metric"], months).select(*keys, "month_number", "month", "metric", "value")
    return long, t.select(*keys, "metric", "fy_total")
