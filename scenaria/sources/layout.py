"""Finding the parts of a sheet by what stands in it: matrix blocks between blank lines, sections under titles.

Nothing here depends on row numbers, so rows inserted above a part change nothing. Windows run over lists of
a sheet's lines, blocks or titles, which aggregates make first; the cells themselves are only joined, so Spark
can split a sheet that holds a large share of all cells. Keys may be NULL; joins treat NULL as a value.

The block functions write their lists of lines and blocks to the checkpoint folder as they go, one small job
each, as every step needs the one before several times. The cells are scanned once a step: they should come
from a landed table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenaria import schema as S
from scenaria.session import checkpoint_dir
from scenaria.sources import reshape


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL; the columns of ``on`` come from the left."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        same = left[c].eqNullSafe(named[f"_on_{c}"])
        cond = same if cond is None else cond & same
    return left.join(named, cond, how).drop(*[f"_on_{c}" for c in on])


def sheet_cells(raw: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Rows ``(keys..., sheet, row_no, c0 .. cN)`` as cells ``(keys..., sheet, row_no, col_no, cell)``."""
    cells = F.array(*[F.col(c).cast("string") for c in reshape.data_columns(raw)])
    return raw.select(*keys, "sheet", "row_no", F.posexplode(cells).alias("col_no", "cell"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own in the checkpoint folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/layout-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _islands(cells: DataFrame, part: Sequence[str], line: str, name: str) -> DataFrame:
    """Numbers the runs of consecutive ``line`` values within ``part``: a gap starts the next one."""
    order = Window.partitionBy(*part).orderBy(line)
    lines = cells.select(*part, line).distinct()
    lines = lines.withColumn("_new", F.when(F.col(line) - F.lag(line).over(order) == 1, 0).otherwise(1))
    return _join(cells, saved(lines.select(*part, line, F.sum("_new").over(order).alias(name)), name.strip("_")), [*part, line])


def find_blocks(cells: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """The matrix blocks of every sheet: ``(keys..., sheet, block, title, top, left, cells...)``, one row per filled cell.

    A block is what blank rows, then blank columns, then blank rows cut out of a sheet, if it holds a row
    with a number right of its first column. The first such row, ``top``, holds the levels of y; the column
    before its first number, ``left``, those of x. ``block`` counts a sheet's blocks in reading order, from
    0; ``title`` is the first text of the rows above ``top`` in the block.
    """
    keys = list(keys)
    sheet = [*keys, "sheet"]
    found, part = cells.where(_filled(F.col("cell"))), list(sheet)
    for i, line in enumerate(("row_no", "col_no", "row_no")):
        found = _islands(found, part, line, f"_island{i}")
        part.append(f"_island{i}")
    number = F.when(F.col("cell").try_cast("double").isNotNull(), F.col("col_no"))
    rows = found.groupBy(*part, "row_no").agg(
        F.min("col_no").alias("_first"),
        F.min(number).alias("_number"),
        F.max(number).alias("_last"),
        F.min(F.struct("col_no", "cell")).alias("_text"),
    )
    rows = rows.withColumn("_edge", F.min("_first").over(Window.partitionBy(*part)))
    blocks = rows.groupBy(*part).agg(
        F.min(F.when(F.col("_last") > F.col("_edge"), F.struct("row_no", "_number"))).alias("_head"),
        F.min(F.when(F.col("_last").isNull(), F.struct("row_no", F.col("_text.cell").alias("text")))).alias("_title"),
    )
    blocks = blocks.where("_head IS NOT NULL").select(
        *part,
        F.col("_head.row_no").alias("top"),
        (F.col("_head._number") - 1).alias("left"),
        F.when(F.col("_title.row_no") < F.col("_head.row_no"), F.trim("_title.text")).alias("title"),
    )
    order = Window.partitionBy(*sheet).orderBy("top", "left")
    blocks = saved(blocks.withColumn("block", F.row_number().over(order) - 1), "blocks")
    return _join(found, blocks, part).drop(*part[len(sheet) :])


def blocks_to_grid(cells: DataFrame, outputs: Mapping[str, Sequence[tuple[str, str]]], keys: Iterable[str] = ()) -> DataFrame:
    """Sheets with any number of matrix blocks -> long grid rows ``(keys..., table, output, x, y, value)``.

    ``outputs`` gives a sheet's (table, output) in reading order of its blocks; a block that it does not
    name is an error, sheets that it does not name are left out. Levels are read from each block. A cell
    that is blank or no number gives a NULL value; positions without a cell give no row. A blank row or
    column inside a matrix makes two blocks of it.
    """
    keys = list(keys)
    cells = cells.where(F.col("sheet").isin(list(outputs)))
    found = find_blocks(cells, keys)
    place = [*keys, "sheet"]
    names = {f"{sheet}\n{i}": o for sheet, listed in outputs.items() for i, o in enumerate(listed)}
    of = F.concat_ws("\n", "sheet", F.col("block").cast("string"))
    named = F.create_map(*[F.lit(v) for n, o in names.items() for v in (n, "\n".join(o))])
    unnamed = F.raise_error(F.concat(F.lit("a block without an output: "), of)).cast("string")
    output = F.split(F.coalesce(F.try_element_at(named, of), unnamed), "\n")
    xs = found.where((F.col("col_no") == F.col("left")) & (F.col("row_no") > F.col("top")))
    xs = xs.select(*place, "row_no", "block", output.alias("_output"), F.col("cell").alias("_x"))
    ys = found.where((F.col("row_no") == F.col("top")) & (F.col("col_no") > F.col("left")))
    ys = ys.select(*place, "col_no", "block", F.col("cell").alias("_y"))
    body = _join(_join(cells, xs, [*place, "row_no"]), ys, [*place, "col_no", "block"])
    return body.select(
        *keys,
        F.col("_output")[0].alias("table"),
        F.col("_output")[1].alias("output"),
        F.col("_x").cast(S.AXIS).alias("x"),
        F.col("_y").cast(S.AXIS).alias("y"),
        F.col("cell").try_cast("double").alias("value"),
    )


def title_text(c: Column) -> Column:
    """A title without its decoration: dividers, blanks and colons around it, upper case."""
    return F.lower(F.regexp_replace(c, r"^[─\-=\s]+|[─\-=:\s]+$", ""))


def find_sections(raw: DataFrame, layout: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Sections found from their titles: ``(keys..., sheet, section, lo, hi)``, rows between lo and hi excluded.

    A title row holds a title of ``layout`` in its first column and nothing else. ``layout`` has one row per
    ``(sheet, title, section)``, with any of the keys besides when layouts differ by key; a title whose
    section is NULL only ends the section before it. A section ends at the next title or with the sheet
    (hi is NULL). A title that stands twice opens its section twice.
    """
    keys = list(keys)
    first, *others = reshape.data_columns(raw)
    alone = _filled(F.col(first))
    for c in others:
        alone = alone & ~_filled(F.col(c))
    rows = raw.where(alone).select(*keys, "sheet", "row_no", title_text(F.col(first)).alias("title"))
    on = [*[k for k in keys if k in layout.columns], "sheet", "title"]
    known = layout.select(*on[:-1], title_text(F.col("title")).alias("title"), "section").distinct()
    titles = _join(rows, known, on)
    after = F.lead("row_no").over(Window.partitionBy(*keys, "sheet").orderBy("row_no"))
    found = titles.select(*keys, "sheet", "section", F.col("row_no").alias("lo"), after.alias("hi"))
    return found.where(F.col("section").isNotNull())


def slice_titled(raw: DataFrame, sections: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Rows of the sections, tagged with ``section``: an equi-join on keys and sheet with the row interval."""
    tagged = _join(raw, sections, [*keys, "sheet"])
    inside = (F.col("row_no") > F.col("lo")) & (F.col("hi").isNull() | (F.col("row_no") < F.col("hi")))
    return tagged.where(inside).drop("lo", "hi")


def table_by_title(
    raw: DataFrame, layout: DataFrame, names: Sequence[str], header: str, keys: Iterable[str] = (), with_dividers: Sequence[str] = ()
) -> DataFrame:
    """Rows of the titled sections with their first columns named, without blank, divider and header rows.

    The first name is the key column, whose cells tell these rows. Sections of ``with_dividers`` keep their
    divider rows.
    """
    keys, names = list(keys), list(names)
    t = slice_titled(raw, find_sections(raw, layout, keys), keys)
    t = reshape.rename_positional(t, names, reshape.data_columns(t, len(names)))
    t = reshape.clean_rows(t.where(_filled(F.col(names[0]))), names[0], drop_dividers=False, header=header)
    kept = F.col("section").isin(list(with_dividers)) if with_dividers else F.lit(False)
    return t.where(kept | ~F.col(names[0]).startswith(reshape.DIVIDER)).select(*keys, "section", *names)


def assumptions_by_title(raw: DataFrame, layout: DataFrame, keys: Iterable[str] = (), header: str = "Driver Name") -> DataFrame:
    """Driver table from sheets whose sections are found from their titles."""
    names = ["driver_name", "unit", "base_case", "low_case", "high_case", "active_value"]
    return table_by_title(raw, layout, names, header, keys)


def engines_by_title(raw: DataFrame, layout: DataFrame, keys: Iterable[str] = (), with_dividers: Sequence[str] = ("revenue_engine",)) -> DataFrame:
    """The engines' step tables in one, told apart by ``section``; the revenue engine keeps its divider rows."""
    return table_by_title(raw, layout, ["metric", "unit", "definition", "value"], "Metric", keys, with_dividers)
