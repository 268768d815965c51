"""Parts of sheets found by what stands in them: matrix blocks and titled sections."""

import pytest
from result_rows import rows

from scenaria.sources import layout as ly

CELLS = "entity string, sheet string, row_no int, col_no int, cell string"


def cells_of(sheet, blocks, entity=None):
    """Cells of blocks given as (row, column, lines of text cells)."""
    return [
        (entity, sheet, r + i, c + j, cell)
        for r, c, lines in blocks
        for i, line in enumerate(lines)
        for j, cell in enumerate(line)
    ]


SMALL = [[None, "0.5", "0.6"], ["0.21", "1", "2"], ["0.25", "3", None], ["0.29", " ", "x"]]
WIDE = [["Growth by price"], ["", "0", "0.01", "0.02"], ["0", "10", "20", "30"], ["0.03", "40", "50", "60"]]
ONE = [["corner", "7"], ["8", "9"]]
OUTPUTS = {"S": [("1A", "rev"), ("1B", "margin"), ("2A", "rev"), ("2B", "margin")]}


def grid(spark, cells, outputs=OUTPUTS, keys=("entity",)):
    got = ly.blocks_to_grid(spark.createDataFrame(cells, CELLS), outputs, keys).collect()
    return sorted(((r["entity"], r["table"], float(r["x"]), float(r["y"]), r["value"]) for r in got), key=lambda r: (str(r[0]), *r[1:4]))


WANT = [
    *[("1A", 0.21, 0.5, 1.0), ("1A", 0.21, 0.6, 2.0), ("1A", 0.25, 0.5, 3.0), ("1A", 0.25, 0.6, None), ("1A", 0.29, 0.5, None), ("1A", 0.29, 0.6, None)],
    *[("1B", x, y, 10.0 * (1 + j + 3 * i)) for i, x in enumerate((0.0, 0.03)) for j, y in enumerate((0.0, 0.01, 0.02))],
    ("2A", 8.0, 7.0, 9.0),
    *[("2B", x, y, 10.0 * (1 + j + 3 * i)) for i, x in enumerate((0.0, 0.03)) for j, y in enumerate((0.0, 0.01, 0.02))],
]


def test_four_blocks_at_any_offsets(spark):
    """Two beside and two below; another entity with other offsets; a sheet that nobody asked for; no entity."""
    one = cells_of("S", [(2, 0, SMALL), (2, 5, WIDE), (9, 3, ONE), (20, 1, WIDE), (40, 0, [["the end"]])], "a")
    two = cells_of("S", [(100, 7, SMALL), (90, 30, [["no numbers", "at all"]]), (101, 50, WIDE), (107, 2, ONE), (107, 9, WIDE)], None)
    got = grid(spark, one + two + cells_of("Other", [(0, 0, ONE)], "a"))
    assert [r[1:] for r in got if r[0] == "a"] == sorted(WANT, key=lambda r: r[:3])
    assert [r[1:] for r in got if r[0] is None] == sorted(WANT, key=lambda r: r[:3])


def test_titles_and_places_of_blocks(spark):
    cells = spark.createDataFrame(cells_of("S", [(4, 2, WIDE), (20, 0, ONE)]), CELLS)
    found = ly.find_blocks(cells).select("sheet", "block", "title", "top", "left").distinct()
    assert rows(found, "block") == [
        {"sheet": "S", "block": 0, "title": "Growth by price", "top": 5, "left": 2},
        {"sheet": "S", "block": 1, "title": None, "top": 20, "left": 0},
    ]


def test_a_block_without_an_output_is_an_error(spark):
    with pytest.raises(Exception, match="a block without an output"):
        grid(spark, cells_of("S", [(0, 0, ONE), (5, 0, ONE)]), {"S": [("1A", "rev")]})


def test_empty_sheets_have_no_grid(spark):
    assert grid(spark, []) == [] == grid(spark, cells_of("S", [(3, 3, [[None, ""]])]))


SHEET = "entity string, sheet string, row_no int, " + ", ".join(f"c{i} string" for i in range(6))
LINES = [
    ["Driver sheet", "of the year"],
    ["── FLEET ──"],
    ["Driver Name", "Unit", "Base", "Low", "High", "Active"],
    ["Fleet Size", "cars", "500", "350", "700", "500"],
    [],
    ["── more ──", "x"],
    ["Pricing:"],
    ["Price", "EUR", "0.29", "0.2", "0.3", "0.29"],
    ["fleet"],
    ["Second Fleet", "cars", "1", "1", "1", "1"],
    ["Notes"],
    ["Price", "EUR", "9", "9", "9", "9"],
]


def sheet_of(lines, entity="a", name="Assumptions", first=0):
    return [(entity, name, first + i, *line, *[None] * (6 - len(line))) for i, line in enumerate(lines)]


@pytest.mark.parametrize("above", [0, 9])
def test_sections_follow_their_titles(spark, above):
    """Rows inserted above, repeated titles, decoration, titles that only end a section, layouts by entity."""
    data = sheet_of(LINES, first=above) + sheet_of([["FLEET"], ["Van", "cars", "2", "2", "2", "2"]], "b", first=above) + sheet_of(LINES, None)
    data += sheet_of(LINES, "a", "Elsewhere")
    known = [("a", "Assumptions", "Fleet", "Fleet & Utilization"), ("a", "Assumptions", "── Pricing", "Pricing"), ("a", "Assumptions", "NOTES", None)]
    known += [("b", "Assumptions", "fleet", "Vans"), ("b", "Assumptions", "fleet:", "Vans"), (None, "Assumptions", "pricing", "Unnamed")]
    layout = spark.createDataFrame(known, "entity string, sheet string, title string, section string")
    got = ly.assumptions_by_title(spark.createDataFrame(data, SHEET), layout, ["entity"])
    assert sorted(map(str, ((r["entity"], r["section"], r["driver_name"], r["base_case"]) for r in got.collect()))) == sorted(
        map(
            str,
            [
                ("a", "Fleet & Utilization", "Fleet Size", "500"),
                ("a", "Fleet & Utilization", "Second Fleet", "1"),
                ("a", "Pricing", "Price", "0.29"),
                ("b", "Vans", "Van", "2"),
                # a layout that knows no other title: the section goes on to the sheet's end
                (None, "Unnamed", "Price", "0.29"),
                (None, "Unnamed", "fleet", None),
                (None, "Unnamed", "Second Fleet", "1"),
                (None, "Unnamed", "Notes", None),
                (None, "Unnamed", "Price", "9"),
            ],
        )
    )
