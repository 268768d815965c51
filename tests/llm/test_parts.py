"""Parts of the operators on their own: slow references, identities and options beyond the queries."""

import random

import llm_tables as lt
import numpy as np
import pytest
from pyspark.sql import functions as F

from scenaria.llm import attention, jaccard, langid, licences, mixing, packing, repeats, sharding, wordhash
from scenaria.llm.common import Scratch
from scenaria.llm.graph import components


def test_code_lengths_equal_a_slow_ppm():
    rng = random.Random(1)
    train = {"a": "abracadabra abra cadabra " * 4, "b": "mississippi river missing " * 5}
    counts = {}
    for lang, text in train.items():
        raw = b"\0\0\0" + text.encode()
        grams = {}
        for i in range(3, len(raw)):
            g = int.from_bytes(raw[i - 3 : i + 1], "big")
            grams[g] = grams.get(g, 0) + 1
        counts[lang] = sorted(grams.items())
    model = langid.Model(counts, max_contexts=10**6)

    def slow(lang: str, text: str) -> float:
        tree = {}
        raw = b"\0\0\0" + train[lang].encode()
        for i in range(3, len(raw)):
            for k in range(4):
                tree.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                tree[raw[i - k : i]][raw[i]] += 1
        bits, raw = 0.0, b"\0\0\0" + text.encode()
        for i in range(3, len(raw)):
            out = set()
            for k in (3, 2, 1, 0):
                seen = {b: n for b, n in tree.get(raw[i - k : i], {}).items() if b not in out}
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if raw[i] in seen:
                    bits -= np.log2(seen[raw[i]] / total)
                    break
                bits -= np.log2(len(seen) / total)
                out |= set(seen)
            else:
                # bytes that no tree has seen share what is left, with the start mark as one of them
                bits += np.log2(256 - len(out))
        return bits

    for _ in range(20):
        text = "".join(rng.choices("abracdmisp rvzé", k=rng.randint(1, 60)))
        if not langid.LETTER.search(text):
            continue
        got = model.code_lengths([text])[0]
        assert got[0] == pytest.approx(slow("a", text), abs=0.01) and got[1] == pytest.approx(slow("b", text), abs=0.01)


def test_long_texts_are_scored_in_segments(monkeypatch):
    rng = random.Random(2)
    text = lt.prose(rng, "de", 3000)
    raw = b"\0\0\0" + text.lower().encode()
    grams = {}
    for i in range(3, len(raw)):
        g = int.from_bytes(raw[i - 3 : i + 1], "big")
        grams[g] = grams.get(g, 0) + 1
    model = langid.Model({"de": sorted(grams.items())}, 10**6)
    whole = model.code_lengths([text, "x"])
    monkeypatch.setattr(langid, "RUN_BYTES", 257)
    assert model.code_lengths([text, "x"]) == pytest.approx(whole, rel=1e-6)


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in attention.initial(rng.integers(1, 99, 24), 6).items()}
    inputs, targets = rng.integers(0, 25, (4, 32)), rng.integers(0, 24, (4, 16)).astype(np.int16)
    exists = rng.random((4, 16)) < 0.8

    def loss() -> float:
        return -float(attention.log_probabilities(w, inputs, targets)[exists].astype(float).sum()) / exists.sum()

    g = attention.gradients(w, inputs, targets, exists)
    for k in w:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            old = w[k][at]
            w[k][at] = old + 0.01
            up = loss()
            w[k][at] = old - 0.01
            down = loss()
            w[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 0.02, abs=2e-4)


def test_attention_learns_and_is_causal():
    rng = np.random.default_rng(1)
    tokens = np.tile(np.array([0, 5, 9, 14, 3], np.int16), 400)
    lengths = np.array([1000, 1000])
    inputs, places, exists, per_text = attention.windows(tokens, lengths, 24)
    assert sorted(places[exists].tolist()) == list(range(2000)) and per_text.tolist() == [63, 63]
    targets = np.where(exists, tokens[np.maximum(places, 0)], 0)
    w = attention.initial(np.bincount(tokens, minlength=24), 6)
    before = attention.log_probabilities(w, inputs, targets)[exists].mean()
    batches = ((inputs[p], targets[p], exists[p]) for _ in range(40) for p in [rng.permutation(len(inputs))[:32]])
    w = attention.train(w, batches, 0.02)
    after = attention.log_probabilities(w, inputs, targets)
    assert after[exists].mean() > before / 5
    later = inputs.copy()
    later[:, -1] = 7  # the last input follows every scored token
    assert np.array_equal(attention.log_probabilities(w, later, targets), after)


def test_fast_encoding_equals_the_tokenizer():
    enc, rng = packing.encoder(), random.Random(3)
    texts = [t for _, t, *_ in lt.documents(n=30) + lt.odd_documents()] + ["foo \n bar", "  lead", "trail  ", "a b c", "it's we'll 3rd 12.5%,", "x. y, z"]
    texts += ["".join(rng.choices("ab \n\t.,'1é ", k=30)) for _ in range(300)]
    for t in texts:
        want = enc.whole.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, repr(t)


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(5)
    for _ in range(20):
        h = np.zeros(65, np.int64)
        h[rng.integers(1, 65, 30)] = rng.integers(0, 500, 30)
        left = h.copy()
        for combo, times in packing.plan(h):
            assert sum(combo) <= 64 and times > 0
            np.subtract.at(left, list(combo), times)
        assert not left.any()
    x = packing.nnls(np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]]), np.array([2.0, -1.0]))
    assert (x >= 0).all() and x == pytest.approx([2.0, 0.0, 0.0], abs=1e-9)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 300), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.component for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 300: 300, 301: 300}


def test_steps_of_components_are_planned_alone(spark):
    """No query of a step holds the step before it, or sends a table through the driver."""
    plans = []

    class Recording(Scratch):
        def save(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name)

    df = Recording(spark, "test").save(spark.createDataFrame([(i + 1, i) for i in range(20)], "a long, b long"), "input")
    got = {(r.vertex, r.component) for r in components(df, Recording(spark, "test")).collect()}
    assert got == {(i, 0) for i in range(21)}
    assert len(plans) > 3
    assert max(p.count("FileScan parquet") for p in plans) <= 4
    assert not any("Broadcast" in p for p in plans)


def test_balancing_moves_slots_to_light_shards(spark):
    sizes = spark.range(64).selectExpr("CAST(id AS INT) AS virtual_slot", "0 AS part", "1 AS part_rows", "IF(id % 4 = 0, 100, 1) * 1 AS part_bytes")
    before = sharding.first_map(spark, 4, 64)
    after = sharding.balance_map(before, sizes, 4)
    load = lambda m: sorted(r.b for r in m.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("part_bytes").alias("b")).collect())
    assert after.count() == 64 and load(before)[-1] == 1600
    assert load(after)[-1] <= 1.3 * sum(load(after)) / 4
    store = sharding.MapStore(spark, Scratch(spark, "test").root)
    store.write(before, 1)
    store.write(after, 2)
    assert load(store.load(1)) == load(before) and load(store.load(2)) == load(after)


def test_temperature_meets_entropy_limit_and_budget(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, lt.prose(rng, "en", 40), "en", "big" if i % 10 else f"s{i // 10 % 4}") for i in range(400)]
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    mixed = mixing.mix(docs, Scratch(spark, "test"), max_epochs=3.0).toPandas()
    tokens = mixed.groupby("source")._tokens.sum()
    uses = mixed.groupby("source").size() / docs.toPandas().groupby("source").size()
    assert uses["big"] == 1 and uses.drop("big").between(2.5, 3.01).all()  # repeated to the limit, and the large source whole
    assert set(mixed.doc_id) == set(range(400))
    weights = mixed.groupby("source").weight.first()
    assert (tokens / tokens.sum()).loc[weights.index].values == pytest.approx(weights.values, abs=0.02)
    some = mixing.mix(docs, Scratch(spark, "test"), max_epochs=3.0, budget_tokens=4000).toPandas()
    assert 3000 < some._tokens.sum() <= 4000 and (some.epoch == 0).all()
    # along the mixture every stretch has about the target weights
    first = mixed.sort_values("mix_position").head(len(mixed) // 2).groupby("source")._tokens.sum()
    assert (first / first.sum()).loc[weights.index].values == pytest.approx(weights.values, abs=0.06)


def test_mixing_equals_sql_when_sources_are_uneven(spark, tmp_path):
    from scenaria.llm.catalog import ORACLE, QUERIES

    rng = random.Random(8)
    rows = [(i, lt.prose(rng, "en", rng.randint(1, 60)), "en", "big" if i % 8 else f"s{i % 3}") for i in range(300)] + [(900, "", None, "void")]
    path = lt.write(tmp_path, rows)
    got = QUERIES["op2_mixing"](spark, path).toPandas()
    assert 0 < got.alpha.iloc[0] < 1 and got.epoch.max() == 1
    lt.same_rows(got, lt.sql(path, ORACLE["op2_mixing"]))


def test_schemes_catch_every_pair_within_reach():
    """Any two sets of similarity 0.9 or more share a key, whatever the levels."""
    rng = np.random.default_rng(9)
    caught = 0
    for trial in range(300):
        n = int(rng.integers(9, 400))
        a = wordhash.mix(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = rng.integers(0, n // 18 + 2, 2)
        b = np.unique(np.concatenate([a[drop:], wordhash.mix(rng.integers(0, 2**63, add).astype(np.uint64))]))
        a = np.unique(a)
        if not jaccard.linked(a, b):
            continue
        caught += 1
        keys = []
        for s in (a, b):
            mine = set()
            for band in jaccard.BANDS.of(len(s)):
                m, need = jaccard.BANDS.segments[band], jaccard.BANDS.covered[band]
                levels = np.full(m, -1)
                order = np.random.default_rng(trial + band).permutation(np.arange(2 * m) % m)[: need + 1]
                levels = np.bincount(order, minlength=m) - 1
                mine |= set(jaccard.segment_keys(s, band, levels)[1].tolist())
            keys.append(mine)
        assert keys[0] & keys[1] or set(a) == set(b)
    assert caught > 100


def test_missing_and_repeated_ids_do_not_multiply(spark, tmp_path):
    """Each distinct set is signed once, whatever ids its rows have."""
    rng = random.Random(14)
    texts = [lt.prose(rng, "en", 60) for _ in range(30)]
    rows = [(None, t, "en", "s") for t in texts for _ in range(3)] + [(7, t, "en", "s") for t in texts] + [(i, None, "en", "s") for i in range(5)]
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    scratch = Scratch(spark, "test")
    sets = scratch.save(jaccard.documents_as_sets(docs, jaccard.BANDS), "sets")
    found = jaccard.texts_of(docs, sets, scratch)
    assert sorted(r.text for r in found.collect()) == sorted(texts)
    got = jaccard.join(docs, scratch).toPandas()
    assert len(got) == len(rows) and (got.component_id[got.n_shingles > 0] == 7).all()


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(15)
    for like in (jaccard.BANDS, jaccard.Similarity(5, 80)):
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 500))).astype(np.uint64))
            drop, add = rng.integers(0, len(a) // 6 + 2, 2)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            if len(b) and like.linked(a, b):
                x, y = (jaccard.parity(s, like) for s in (a, b))
                words = min(len(x), len(y)) // 8
                assert np.bitwise_count(jaccard._folded(x, words) ^ jaccard._folded(y, words)).sum() <= like.differing(len(a) + len(b))


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard_of_a_large_group_of_near_copies(spark, tmp_path, words, percent):
    """Copies with zero to many changed words: some pairs link, some do not, and components must not lose any."""
    rng = random.Random(10)
    base = lt.prose(rng, "en", 120).split(" ")
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s"))
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, Scratch(spark, "test"), jaccard.Similarity(words, percent)).collect()}
    groups = lt.jaccard_components(rows, words, percent)
    assert got == {i: min(groups[i]) for i in groups} and 1 < len(set(got.values())) < 160


def test_phrases_cut_equal_strings_alike():
    rng = np.random.default_rng(11)
    shared = rng.integers(97, 100, 500).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared, rng.integers(97, 123, 90).astype(np.uint8)]) for n in (10, 333)]
    triggers = []
    for t in texts:
        lo, hi, lead, h, c = repeats.phrases(t, np.ones(len(t) - 199, bool))
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
        assert starts.tolist() == list(range(len(t) - 199))  # every string is in one phrase
        at = len(t) - 590
        triggers.append({(a + d - at) for a, d in zip(lo, lead, strict=True) if at <= a <= at + 300})
    assert triggers[0] & triggers[1]


def test_runs_of_one_byte_and_long_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    long = lt.prose(rng, "fr", 9000)
    rows = [(0, "a" * 700, "en", "s"), (1, "ab" * 300, "en", "s"), (2, long, "fr", "s"), (3, "x" + long[20_000:20_900], "fr", "s")]
    monkeypatch.setattr(repeats, "RUN", 1 << 12)
    docs = spark.read.parquet(lt.write(tmp_path, rows) + "/documents.parquet")
    got = repeats.remove(docs, repeats.repeated_spans(docs, Scratch(spark, "test"))).toPandas().set_index("doc_id")
    cover = lt.repeated_cover([r[1] for r in rows])
    assert got.n_removed.tolist() == [int(cover[i].sum()) for i in got.index] and got.n_removed[3] > 800


def test_filters_of_the_licence_join_lose_nothing():
    rng = random.Random(13)
    index = licences.Templates(licences.TEMPLATES, {b"license": 90, b"the": 5000, b"under": 300})
    vocabulary = sorted(licences.template_words(licences.TEMPLATES)) + [b"noise%d" % i for i in range(10)]
    for _ in range(3000):
        block = set(rng.choices(vocabulary, k=rng.randint(0, 24)))
        if rng.random() < 0.7:
            block |= set(licences.words_of(rng.choice(list(licences.TEMPLATES)))) - set(rng.choices(vocabulary, k=2))
        want = set()
        for k, (_, ranked, _, need) in enumerate(index.sets):
            if sum(index.order[w] in ranked for w in block if w in index.order) >= need:
                want.add(k)
        assert {k for k, _ in index.match(block)} == want
        if want:
            assert index.candidate(b" " + b" ".join(block) + b" ")
