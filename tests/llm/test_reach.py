"""Keys that a set can spare, bits a byte of all labelled texts."""

import random

import llm_tables as lt
import numpy as np
import pytest

from scenaria.llm import jaccard, langid, wordhash


def random_set(rng, n):
    return np.unique(wordhash.mix(rng.integers(0, 2**63, n).astype(np.uint64)))


@pytest.mark.parametrize("like", [jaccard.BANDS, jaccard.Similarity(5, 80)], ids=["3 words", "5 words"])
def test_sets_spare_keys_and_lose_no_linked_pair(like):
    rng = np.random.default_rng(11)
    levels_of, caught, spared, whole, empty = {}, 0, 0, 0, 0
    for _ in range(1500):
        n = int(rng.integers(4, 500))
        a = random_set(rng, n)
        drop, add = rng.integers(0, n * (100 - like.numerator) // 90 + 2, 2)
        b = np.unique(np.concatenate([a[drop:], random_set(rng, add)]))
        if not len(b) or not like.linked(a, b):
            continue
        caught += 1
        keys = []
        for s in (a, b):
            mine = set()
            for band in like.of(len(s)):
                m, need = like.segments[band], like.need(len(s), band)
                assert need <= like.covered[band]
                if band not in levels_of:
                    order = rng.permutation(np.arange(2 * m) % m)[: like.covered[band] + 1]
                    levels_of[band] = np.maximum(np.bincount(order, minlength=m) - 1, rng.integers(-1, 1))
                levels = levels_of[band]
                kept = set(jaccard.segment_keys(s, band, levels, like, need)[1].tolist())
                every = set(jaccard.segment_keys(s, band, levels, like)[1].tolist())
                assert kept <= every
                mine |= kept
                spared, whole = spared + len(every) - len(kept), whole + len(every)
            keys.append(mine)
        assert keys[0] & keys[1] or (len(a) == len(b) and (a == b).all())
    assert caught > 400 and spared > whole / 20


def test_few_sets_are_met_in_empty_segments():
    """Unrelated sets at the low end of a band meet by chance where both have nothing."""
    rng, like = np.random.default_rng(12), jaccard.Similarity(5, 80)
    band = 9
    levels = np.zeros(like.segments[band], np.int64)
    sets = [random_set(rng, like.low[band]) for _ in range(100)]
    for need, most in ((None, 1000), (like.need(like.low[band], band), 0)):
        keys = np.concatenate([np.unique(jaccard.segment_keys(s, band, levels, like, need)[1]) for s in sets])
        met = int((np.unique(keys, return_counts=True)[1] - 1).sum())
        assert met > 500 if need is None else met == most


def test_usual_rates_come_from_all_labelled_texts(spark):
    """The costliest text of a language sets its rate, whatever the sample of the trees."""
    rng = random.Random(13)
    rows = [(("en", "de")[i % 2], lt.prose(rng, ("en", "de")[i % 2], 120)) for i in range(300)]
    schema = "lang string, text string"
    usual = langid.usual_rates(spark.createDataFrame(rows, schema), 20_000)
    assert set(usual) == {"en", "de"}
    for i in range(3):  # drawn or not, and in either half
        odd = lt.prose(rng, "en", 60) + " " + "".join(rng.choices("zqxjkvwpy", k=150))
        got = langid.usual_rates(spark.createDataFrame([*rows, ("en", odd)], schema), 20_000)
        assert got["en"] > 1.2 * usual["en"] and got["de"] == pytest.approx(usual["de"], rel=0.05), i
    few = [("xx", lt.prose(rng, "fr", 120)) for _ in range(langid.RATED_TEXTS - 1)]
    assert set(langid.usual_rates(spark.createDataFrame([*rows, *few], schema), 20_000)) == {"en", "de"}
