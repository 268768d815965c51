"""Results that do not end at a window, a line or a sample."""

import random

import llm_tables as lt
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from scenaria.llm import attention, licences, scoring, vectors
from scenaria.llm.common import Scratch


@pytest.mark.parametrize("chunk_bytes", [vectors.CHUNK_BYTES, 1 << 20])
def test_vectors_lose_no_lone_pair(spark, tmp_path, chunk_bytes):
    """Lone pairs at cosine 0.955 among vectors without any other link, all of them found."""
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((4000, 64)))
    b = rng.standard_normal((4000, 64))
    b = 0.955 * a + np.sqrt(1 - 0.955**2) * unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    x = np.concatenate([a, b]).astype(np.float32)
    path = lt.write(tmp_path, [], vectors=(list(range(8000)), x.tolist()))
    table = spark.read.parquet(f"{path}/embeddings.parquet")
    got = vectors.near_duplicates(table, Scratch(spark, "test"), chunk_bytes=chunk_bytes).toPandas().set_index("vec_id")
    y = unit(x.astype(float))
    links = np.concatenate([(y[i : i + 1000] @ y.T >= 0.95).sum(axis=1) - 1 for i in range(0, 8000, 1000)])
    assert links.tolist() == got.n_links[range(8000)].tolist() and (links == 1).all()
    assert got.component_id[range(8000)].tolist() == [*range(4000), *range(4000)]
    assert got.kept.sum() == 4000


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
HEADERS = {
    "mit": MIT,
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
    "mpl": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not",
}


def test_wrapped_licences_at_any_place(spark, tmp_path):
    rows = [(i, "word " * (7 * i) + "\n" + list(HEADERS.values())[i % 3] + "\nword" * (5 * i), "en", "s") for i in range(60)]
    rows += [(100, " ".join(("pad " * 9).join(MIT.split()[:17]).split()), "en", "s")]  # nine words between any two: no block holds it
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    got = licences.scan(docs).toPandas().set_index("doc_id")
    assert [got.labels[i] for i in range(60)] == [list(HEADERS)[i % 3] for i in range(60)]
    assert (got.score[range(60)] == 1).all() and got.labels[100] == ""


def test_a_whole_licence_text_as_template(spark, tmp_path):
    """A template longer than a block of BLOCK_WORDS words, wherever it begins."""
    template = " ".join(w.decode() for w in licences.words_of(MIT + MIT.upper().replace("SOFTWARE", "WORK")))
    assert len(template.split()) > licences.BLOCK_WORDS
    rows = [(i, "word " * (11 * i) + template, "en", "s") for i in range(40)]
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    got = licences.scan(docs, {template: "whole"}, {}).toPandas()
    assert (got.labels == "whole").all() and (got.score == 1).all()


def test_pipeline_drops_near_copies_between_08_and_09(spark, tmp_path):
    """Copies with some words changed, against all pairs on 5-word shingles at 0.8."""
    rng = random.Random(18)
    rows = []
    for i in range(60):
        w = lt.prose(rng, "en", rng.choice((12, 50, 120, 400))).split(" ")
        rows.append((5 * i, " ".join(w), "en", "s"))
        for j in range(1, 5):
            v = list(w)
            for _ in range(rng.choice((1, 1, 2, 3, 6))):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            rows.append((5 * i + j, " ".join(v), "en", "s"))
    sets = [lt.shingle_set(r[1], 5) for r in rows]
    c, between = lt.Components(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                c.join(i, j)
                between += 10 * len(a & sets[j]) < 9 * len(a | sets[j])
    want = {}
    for i in range(len(rows)):
        want.setdefault(c.find(i), i)
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    got = cp.near_duplicates(spark, docs, str(tmp_path)).toPandas()
    assert sorted(got.doc_id) == sorted(want.values()) and between > 50


def test_attention_trains_on_all_training_texts(spark, tmp_path, monkeypatch):
    """Every text outside the held-out fold reaches the training, in a corpus of more than a few MB too."""
    rng, given = random.Random(19), []
    rows = [(i, lt.prose(rng, "en", 300) * 40, "en", "s") for i in range(60)]
    assert sum(len(r[1]) for r in rows) > 4_000_000

    def fit(sample, classes):
        given.append(sorted(len(x.ids) // 2 for x in sample.collect()))
        return attention.initial(classes.counts, scoring.MEMBERS)

    monkeypatch.setattr(scoring, "fit", fit)
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    scoring.score(docs, F.col("doc_id") % 7 == 2, Scratch(spark, "test"))
    sizes = [1 + sum(len(scoring.subword_ids(w)) for w in scoring.words_of(r[1])) for r in rows if r[0] % 7 != 2]
    assert given == [sorted(sizes)]


def test_rounds_add_up_weights_in_tasks(spark, monkeypatch):
    """The driver gets at most FAN rows of sums from a round, and the weights are the tasks' average."""
    monkeypatch.setattr(scoring, "TASK_SUBWORDS", 300)
    monkeypatch.setattr(scoring, "FAN", 4)
    monkeypatch.setattr(scoring, "ROUNDS", 1)
    rng = np.random.default_rng(23)
    texts = [rng.integers(0, 2000, rng.integers(1, 80)).astype("<u2") for _ in range(200)]
    counts = np.bincount(np.concatenate(texts), minlength=scoring.VOCABULARY)
    classes = scoring.Classes(counts)
    sample = spark.createDataFrame([(i * 7919 % 1009, bytearray(x.tobytes())) for i, x in enumerate(texts)], "h long, ids binary")
    tasks = sum(map(len, texts)) // 300
    assert tasks > scoring.FAN**2
    dealt = sample.repartition(tasks, "h").sortWithinPartitions("h").withColumn("part", F.spark_partition_id()).collect()
    sent, collect = [], type(sample).collect
    monkeypatch.setattr(type(sample), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    got = scoring.fit(sample, classes)
    assert max(map(len, sent)) <= scoring.FAN

    w, flats, sizes = attention.initial(classes.counts, scoring.MEMBERS), [], []
    for part in sorted({r.part for r in dealt}):
        ids = [np.frombuffer(r.ids, "<u2") for r in dealt if r.part == part]
        tokens = classes.of[np.concatenate(ids)]
        inputs, places, exists, _ = attention.windows(tokens, np.array([len(x) for x in ids]), classes.start)
        targets = np.where(exists, tokens[np.maximum(places, 0)], 0)
        order = np.random.default_rng(0).permutation(len(inputs))
        parts = [order[i : i + scoring.BATCH] for i in range(0, len(order), scoring.BATCH)]
        flats.append(attention.flatten(attention.train(w, ((inputs[p], targets[p], exists[p]) for p in parts), scoring.RATE)))
        sizes.append(len(inputs))
    assert np.allclose(attention.flatten(got), np.average(flats, axis=0, weights=sizes), atol=1e-6)
    assert not np.allclose(attention.flatten(got), attention.flatten(w), atol=1e-3)


def test_scores_against_texts_one_by_one(spark, tmp_path, monkeypatch):
    """With weights given, each score is the sum over the text's own windows, of odd and of long texts too, in many chunks."""
    rows = lt.odd_documents() + [(900 + i, lt.prose(random.Random(i), "en", 5 + 700 * i), "en", "s") for i in range(5)]
    monkeypatch.setattr(scoring, "SCORED_SUBWORDS", 500)
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 5000)
    assert sum(len(r[1] or "") for r in rows) > 3 * scoring.SLICES * scoring.CHUNK_BYTES
    given = []

    def fit(sample, classes):
        rng = np.random.default_rng(3)
        w = {k: (x + 0.3 * rng.standard_normal(x.shape)).astype(np.float32) for k, x in attention.initial(classes.counts, scoring.MEMBERS).items()}
        given.append((w, classes))
        return w

    monkeypatch.setattr(scoring, "fit", fit)
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    got = scoring.score(docs, F.col("doc_id") % 7 == 2, Scratch(spark, "test")).toPandas().set_index("doc_id").score
    (w, classes), *_ = given
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        ids = np.concatenate([*(scoring.subword_ids(x) for x in scoring.words_of(text)), np.array([scoring.END], "<u2")])
        kinds = classes.of[ids]
        inputs, places, exists, _ = attention.windows(kinds, np.array([len(ids)]), classes.start)
        log_p = attention.log_probabilities(w, inputs, np.where(exists, kinds[np.maximum(places, 0)], 0))[exists].sum(dtype=float)
        assert got[i] == pytest.approx((log_p + classes.log_inside[ids].sum(dtype=float)) / np.log(10), rel=1e-5)


@pytest.mark.parametrize("odd", [0, 59, 60, 61, -61, np.inf, -np.inf, np.nan])
def test_held_values_are_clipped_ones(odd):
    """Values that need no clipping stay; one that does, or is no number, doesn't hide the others."""
    for others in (1, 70, -70):
        values = np.array([[0.5, odd, -3], [others, 2, -1]], np.float32)
        want = np.clip(values, -attention.REACH, attention.REACH)
        assert np.array_equal(attention._hold(values), want, equal_nan=True) and np.array_equal(values, want, equal_nan=True)


def test_adam_in_one_vector():
    """The same weights as Adam by array."""
    rng = np.random.default_rng(29)
    w = attention.initial(rng.integers(1, 99, 24), 6)
    tokens = rng.integers(0, 24, 900).astype(np.int16)
    inputs, places, exists, _ = attention.windows(tokens, np.array([500, 1, 399]), 24)
    targets = np.where(exists, tokens[np.maximum(places, 0)], 0)
    batches = [(inputs[i : i + 16], targets[i : i + 16], exists[i : i + 16]) for i in range(0, len(inputs), 16)]
    got = attention.train(w, batches, 0.01)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    want = {k: x.copy() for k, x in w.items()}
    for step, batch in enumerate(batches, 1):
        for k, g in attention.gradients(want, *batch).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            want[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    assert all(np.array_equal(got[k], want[k]) for k in want)
