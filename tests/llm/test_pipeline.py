"""The corpus pipeline against a brute-force version of its stages, and its defined results."""

import random
from pathlib import Path

import llm_tables as lt
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from scenaria.llm import packing
from scenaria.llm.common import Scratch
from scenaria.session import checkpoint_dir

COLUMNS = list(cp.COLUMNS)


def changed(seed: int, first_id: int) -> list[tuple]:
    """Texts of 100 to 160 words with copies that differ in one word or two: mostly between 0.8 and 0.9 on five words."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        words = lt.prose(rng, "en", rng.randint(100, 160)).split(" ")
        for changes in (0, 1, 2, 3):
            copy = list(words)
            for at in rng.sample(range(5, len(copy) - 5), changes):
                copy[at] = f"changed{rng.randrange(10**6)}"
            rows.append((first_id + len(rows), " ".join(copy), "en", "s1"))
    return rows


ROWS = [*lt.documents(seed=21), *lt.odd_documents(), *changed(23, 2000)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    return lt.write(tmp_path_factory.mktemp("pipeline"), ROWS, extra=True)


def test_rows_tell_the_similarities_apart():
    groups = [{tuple(g) for g in lt.jaccard_components(ROWS, *like).values()} for like in ((5, 80), (3, 90), (5, 90), (3, 80))]
    assert all(groups[0] != g for g in groups[1:])


def stage(spark, name, rows, tmp_path):
    """A stage alone on the given rows."""
    path = lt.write(tmp_path, rows)
    return dict(cp.STAGES)[name](spark, spark.read.parquet(f"{path}/documents.parquet"), path)


def brute_force(rows):
    """The rows that each stage keeps, in order: languages, one of each group of near copies, repeats out."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = lt.jaccard_components(rows, 5, 80)
    rows = [rows[i] for i in sorted({min(g, key=lambda j: rows[j][0]) for g in groups.values()})]
    cover = lt.repeated_cover([r[1] for r in rows])
    cut = [np.frombuffer(r[1].encode(), np.uint8)[~c].tobytes().decode(errors="ignore") for r, c in zip(rows, cover, strict=True)]
    return {r[0]: t for r, t in zip(rows, cut, strict=True)}


def test_run_equals_brute_force(spark, tables):
    want = brute_force(ROWS)
    got = cp.run(spark, tables).toPandas()
    whole = Tokenizer.from_file(packing.TOKENIZER)
    tokens = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    firsts = got[got.start == 0]
    assert set(firsts.doc_id) == set(tokens)  # clean documents stay
    assert dict(zip(firsts.doc_id, firsts.doc_tokens, strict=True)) == tokens
    uses = firsts.groupby("doc_id").size()
    assert uses.between(1, 2).all()
    assert got.length.sum() == sum(tokens[i] * n for i, n in uses.items())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 2048


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kinds = dict(docs.dtypes)
    for name, f in cp.STAGES[:-1]:
        out = f(spark, docs, tables)
        assert out.columns == COLUMNS and all(kinds[c] == t for c, t in out.dtypes), name


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_empty_input(spark, tmp_path, name):
    assert stage(spark, name, [], tmp_path).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_missing_values_and_repeated_rows(spark, tmp_path, name):
    rows = lt.documents(seed=22, n=30) + changed(24, 2000)
    rows += rows[:4] + [(None, None, None, None), (None, rows[6][1], None, None), (3, rows[8][1], "en", None), (50, "word", None, "s")]
    got = stage(spark, name, rows, tmp_path).toPandas()
    if name == "near_duplicates":
        groups = {tuple(g) for g in lt.jaccard_components(rows, 5, 80).values()}
        assert len(got) == len(groups)
        order = lambda r: (r[0] is None, r[0] or 0)
        want = sorted(repr(min((rows[j] for j in g), key=order)[0]) for g in groups)
        assert sorted(repr(None if np.isnan(x) else int(x)) for x in got.doc_id.astype(float)) == want
    elif name == "repeated_strings":
        cover = lt.repeated_cover([r[1] for r in rows])
        want = sorted(len(np.frombuffer((r[1] or "").encode(), np.uint8)[~c].tobytes().decode(errors="ignore")) for r, c in zip(rows, cover, strict=True))
        assert sorted(got.n_chars) == want == sorted(map(len, got.text))
    elif name == "language":
        assert len(got) == len(rows) - 1 and not got.lang.isna().any()
    elif name == "mixture":
        assert len(got) >= len(rows) and len(got[got.doc_id.isna()]) >= 2
    else:
        assert (got.start == 0).sum() == len(rows)


@pytest.mark.parametrize("name,left", [("near_duplicates", {"rows", "stay"}), ("repeated_strings", {"spans"})])
def test_tables_of_finished_steps_go(spark, tmp_path, name, left):
    shared = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    got = stage(spark, name, ROWS, tmp_path)
    tables = {p.parent for top in set(shared.iterdir()) - before for p in top.rglob("*.parquet") if p.is_file()}
    assert {t.name.partition("-")[2] for t in tables} == left
    assert got.count() == (len({tuple(g) for g in lt.jaccard_components(ROWS, 5, 80).values()}) if name == "near_duplicates" else len(ROWS))


def test_dropping_leaves_the_other_tables(spark):
    scratch = Scratch(spark, "drop")
    inner = scratch.part("inner")
    a, b, c = scratch.save(spark.range(3), "same"), scratch.save_parts((spark.range(k) for k in (4, 1)), "same"), inner.save(spark.range(6), "same")
    top = Path(scratch.root.removeprefix("file:"))
    scratch.drop(a)
    assert sorted(p.name for p in top.iterdir() if p.name[0] == "0") == ["002-same"]
    assert (b.count(), c.count()) == (5, 6)
    inner.drop()
    assert b.count() == 5 and not list(top.glob("inner-*"))
