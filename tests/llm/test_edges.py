"""Short pieces, ordered parts of large blocks, clashing names, unlearned languages, whole texts against SQL."""

import random
import zlib

import corpus_pipeline as cp
import llm_tables as lt
import numpy as np
import pytest
from pyspark.sql import functions as F

from scenaria.llm import langid, mixing, packing
from scenaria.llm.catalog import ORACLE, QUERIES
from scenaria.llm.common import Scratch


def docs_of(spark, tmp_path, rows):
    return spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")


@pytest.mark.parametrize("words", [[0], [19], [1, 4, 9, 30], list(range(60, 700, 7))])
def test_short_pieces_fill_their_windows(spark, tmp_path, words):
    rows = [(i, " ".join(["word"] * words[i % len(words)]), "en", "s") for i in range(12_000)]
    got = QUERIES["op7_packing"](spark, lt.write(tmp_path, rows)).toPandas()
    assert len(got) == len(rows) and (got.length >= 1).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= packing.WINDOW
    sequences = got.sequence_id.nunique()
    assert sorted(got.sequence_id.unique()) == list(range(sequences))
    least = -(-int(got.length.sum()) // packing.WINDOW)
    assert sequences <= least / 0.96 + 1


def test_most_short_pieces_stand_in_combinations():
    rng = np.random.default_rng(3)
    for low, high in ((1, 2), (20, 21), (1, 64)):
        h = np.bincount(rng.integers(low, high, 50_000), minlength=packing.WINDOW + 1)
        known = {tuple(sorted(c.items())) for c in packing.combinations(np.flatnonzero(h).tolist(), packing.WINDOW)}
        of = lambda combo: tuple(sorted((u, combo.count(u)) for u in set(combo)))
        inside = sum(len(c) * n for c, n in packing.plan(h) if of(c) in known)
        assert inside > 0.9 * h.sum()


def test_size_classes_hold_their_lengths(spark):
    got = spark.range(1, 2049).select(F.col("id").alias("n"), packing.size_class(F.col("id")).alias("c")).toPandas()
    assert (got.c >= got.n).all() and (got.c <= packing.WINDOW).all()
    assert (got.c - got.n <= np.minimum(got.n / 32, packing.GRAIN - 1)).all()


def test_combinations_fill_a_window():
    present = [1, 3, 20, 64, 100, 260, 512, 520, 700, 1024, 1348, 2047]
    for combo in packing.combinations(present, 2048):
        total = sum(u * n for u, n in combo.items())
        assert set(combo) <= set(present) and 0.99 * 2048 <= total <= 2048


def test_parts_of_large_blocks_leave_the_mixture_as_it_is(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, lt.prose(rng, "en", rng.randint(0, 40)), "en", "big" if i % 8 else f"s{i % 3}") for i in range(600)]
    rows += rows[:9] + [(None, None, None, None)]
    docs = docs_of(spark, tmp_path, rows)

    def mixed():
        return mixing.mix(docs, Scratch(spark, "test"), n_blocks=3).select("doc_id", "source", "epoch", "_block", "_upto", "mix_position").toPandas()

    whole = mixed()
    monkeypatch.setattr(mixing, "PART_ROWS", 2)
    lt.same_rows(mixed(), whole)


def test_mixing_replaces_columns_named_like_its_own(spark, tmp_path):
    rng = random.Random(5)
    docs = docs_of(spark, tmp_path, [(i, lt.prose(rng, "en", 30), "en", f"s{i % 3}") for i in range(60)])
    extra = docs.withColumns({n: F.lit("given") for n in ("quota", "Weight", "block_tokens", "_digest", "_before", "alpha", "EPOCH", "kept")})
    got = mixing.mix(extra, Scratch(spark, "test"))
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    want = mixing.mix(docs, Scratch(spark, "test"))
    shown = ["doc_id", "epoch", "weight", "quota", "alpha", "mix_position"]
    lt.same_rows(got.select(*shown).toPandas(), want.select(*shown).toPandas())
    assert {r.kept for r in got.select("kept").collect()} == {"given"}


def test_languages_equal_a_slow_ppm(spark, tmp_path):
    """The query over a whole table, with all contexts, against trees of dictionaries."""
    rng = random.Random(6)
    rows = []
    for i in range(40):
        lang = rng.choice(list(lt.WORDS))
        rows.append((i, lt.prose(rng, lang, rng.choice((1, 4, 25))), lang if i % 7 else None, "s"))
    rows += [(50, "12 3", "en", "s"), (51, None, "de", "s")]
    trees = {}
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 == 1 or lang is None or not langid.LETTER.search(text or ""):
            continue
        raw = b"\0\0\0" + text.lower().encode()
        for at in range(3, len(raw)):
            for k in range(4):
                seen = trees.setdefault(lang, {}).setdefault(raw[at - k : at], {})
                seen[raw[at]] = seen.get(raw[at], 0) + 1

    def bits(tree, text):
        total, raw = 0.0, b"\0\0\0" + text.lower().encode()
        for at in range(3, len(raw)):
            out = set()
            for k in (3, 2, 1, 0):
                left = {b: n for b, n in tree.get(raw[at - k : at], {}).items() if b not in out}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if raw[at] in left:
                    total -= np.log2(left[raw[at]] / whole)
                    break
                total -= np.log2(len(left) / whole)
                out |= set(left)
            else:
                total += np.log2(256 - len(out))
        return total

    got = QUERIES["op3_language"](spark, lt.write(tmp_path, rows)).toPandas().set_index("doc_id")
    for i, text, _, _ in rows:
        if not langid.LETTER.search(text or ""):
            assert got.lang_pred[i] == "und" and got.score[i] == 0
            continue
        cost = {lang: bits(tree, text) for lang, tree in trees.items()}
        best = min(sorted(cost), key=cost.get)
        assert got.lang_pred[i] == best
        assert got.score[i] == pytest.approx(1 / sum(2 ** (cost[best] - c) for c in cost.values()), abs=0.01)


def test_texts_of_unlearned_languages_go(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, lt.prose(rng, ("en", "de", "fr")[i % 3], 120), ("en", "de", "fr")[i % 3], "s") for i in range(600)]
    strange = "jxq zvk wpy qgh xkz bvj fhw qzx kjy vwq".split()
    noise = [(1000 + i, " ".join("".join(rng.choices(strange, k=2)) for _ in range(200)), None, "s") for i in range(3)]
    noise += [(1100, "日本語のテキストは長く続きます。" * 40, None, "s")]
    clean = [(2000, "short unlike zq", None, "s"), (2001, lt.prose(rng, "en", 90) + " " + " ".join(strange), None, "s")]
    kept = {r.doc_id for r in cp.language(spark, docs_of(spark, tmp_path, rows + noise + clean), str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows + clean}


def test_wrapped_licences_equal_sql(spark, tmp_path):
    header = "Permission is hereby granted, free of charge,\nto any person obtaining\na copy of this software"
    code = "This Source Code Form is subject\nto the terms of the\nMozilla Public License, v. 2.0"
    rng = random.Random(8)
    rows = [(i, f"{lt.prose(rng, 'en', 17 * i)} {(header, code)[i % 2]} {lt.prose(rng, 'en', 9)}", "en", "s") for i in range(12)]
    spread = " ".join(f"{w} {lt.prose(rng, 'de', 6)}" for w in header.split())  # its words are too far apart
    many = "the MIT License " * 400
    rows += [(20, spread, "en", "s"), (21, many, "en", "s"), (22, None, "en", "s"), (23, "", "en", "s")]
    path = lt.write(tmp_path, rows)
    got = QUERIES["op5_licences"](spark, path).toPandas()
    lt.same_rows(got, lt.sql(path, ORACLE["op5_licences"]))
    labels = got.set_index("doc_id").labels
    assert all(labels[i] == ("mit", "mpl")[i % 2] for i in range(12)) and labels[20] == ""
    assert got.set_index("doc_id").n_base[21] == 400
