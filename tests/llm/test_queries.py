"""The registered operator queries: SQL over whole tables, brute force, odd rows and empty tables."""

import hashlib
import math
import os
import zlib
from collections import Counter

import llm_tables as lt
import numpy as np
import pytest
from tokenizers import Tokenizer

from scenaria.llm import packing
from scenaria.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Ordinary and odd documents together, with extra columns of clashing names."""
    return lt.write(tmp_path_factory.mktemp("tables"), lt.documents() + lt.odd_documents(), extra=True, vectors=lt.vectors(), pages=lt.pages())


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Rows that repeat as a whole, ids that repeat with other texts, rows without an id."""
    rows = lt.documents(seed=2, n=40) + lt.odd_documents()[:8]
    rows += rows[:5] + [(7, "another text under an id that is taken", "en", "s1"), (None, rows[1][1], "en", "hot"), (None, None, None, None)]
    ids, vecs = lt.vectors()
    return lt.write(tmp_path_factory.mktemp("repeated"), rows, vectors=(ids + [0, 1, None], vecs + [vecs[0], vecs[20], vecs[1]])), rows


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return lt.write(tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("which", ["given", "odd"])
def test_query_equals_sql(spark, tables, name, which):
    if which == "given" and not os.path.isdir(SF):
        pytest.skip("test tables not present")
    path = SF if which == "given" else tables
    lt.same_rows(QUERIES[name](spark, path).toPandas(), lt.sql(path, ORACLE[name]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_repeated_and_missing_ids(spark, repeated, name):
    path, rows = repeated
    got = QUERIES[name](spark, path).toPandas()
    if name in ("op11_phrases", "op13_warc"):  # not by document; pages have rows of their own
        assert len(got) == (0 if name == "op13_warc" else got["rank"].count())
        return
    if name == "op9_vectors":
        assert len(got) == 3 + len(lt.vectors()[0])
        assert (got[got.vec_id.isna()].n_links == 0).all()
        assert got[got.vec_id == 0].n_links.min() >= 2
        return
    ids = Counter(r[0] for r in rows)
    per_doc = {"op2_mixing": ("epoch", 0), "op7_packing": ("start", 0)}.get(name)
    some = got if per_doc is None else got[got[per_doc[0]] == per_doc[1]]
    assert Counter(None if math.isnan(x) else int(x) for x in some.doc_id.astype(float)) == ids
    if name == "op1_sharding":
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
    if name == "op4_repeats":
        cover = lt.repeated_cover([r[1] for r in rows])
        assert sorted(got.n_removed) == sorted(int(c.sum()) for c in cover)
    if name == "op7_packing":
        check_packing(got)
    if name == "op10_jaccard":
        groups = lt.jaccard_components(rows)
        want = sorted((repr(rows[i][0]), repr(min((rows[j][0] for j in groups[i] if rows[j][0] is not None), default=None))) for i in groups)
        clean = lambda x: repr(None if math.isnan(x) else int(x))
        assert sorted((clean(a), clean(b)) for a, b in zip(got.doc_id.astype(float), got.component_id.astype(float), strict=True)) == want


def test_language_of_held_out_texts(spark, tables):
    rows = {r[0]: r for r in lt.documents() + lt.odd_documents()}
    got = QUERIES["op3_language"](spark, tables).toPandas().set_index("doc_id")
    assert (got.held_out == [lt.fold(i, 3) == 1 for i in got.index]).all()
    assert set(got.loc[[100, 101, 102, 103], "lang_pred"]) == {"und"} and (got.loc[[100, 101, 102, 103], "score"] == 0).all()
    held = [i for i in got.index if got.held_out[i] and i < 100 and len(rows[i][1].split()) >= 20]
    assert np.mean([got.lang_pred[i] == rows[i][2] for i in held]) >= 0.95
    assert got.score.between(0, 1).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_language_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    got = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang.loc[held.index]).mean() >= 0.97


def test_scores(spark, tables):
    rows = lt.documents() + lt.odd_documents()
    words = {r[0]: (r[1] or "").encode().lower().split() + ["end"] for r in rows}
    counts = Counter(w for i, ws in words.items() if lt.fold(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op6_scores"](spark, tables).toPandas().set_index("doc_id")
    for i, ws in words.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-12)
        assert r.held_out == (lt.fold(i, 7) == 2)
        assert r.score < 0
    # A model that has learned: far better than evenly likely subwords (log10 50257 = 4.7 each).
    held = got[got.held_out & (got.n_tokens > 10)]
    assert held.score.sum() / held.n_tokens.sum() > -2.5 * 4.7


def check_packing(got, rows=None):
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 2048
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


def test_packing(spark, tables):
    rows = {r[0]: r[1] for r in lt.documents() + lt.odd_documents()}
    whole = Tokenizer.from_file(packing.TOKENIZER)
    got = QUERIES["op7_packing"](spark, tables).toPandas()
    check_packing(got)
    for i, g in got.groupby("doc_id"):
        ids = np.array(whole.encode(rows[i] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        g = g.sort_values("start")
        assert (g.doc_tokens == len(ids) // 4).all()
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() == len(ids) // 4
        for r in g.itertuples():
            assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert set(got.doc_id) == set(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_packing_leaves_little_padding(spark):
    got = QUERIES["op7_packing"](spark, "/root/testdata/sf0.01").toPandas()
    check_packing(got)
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.97


def test_shards_grow_into_the_new_one_only(spark, tables):
    got = QUERIES["op1_sharding"](spark, tables).toPandas()
    moved = got[got.grown_shard != got.shard]
    assert (moved.grown_shard == 16).all() and got.shard.between(0, 15).all()


def test_winnowed_texts_that_share_a_run_share_a_gram(spark, tmp_path):
    rng = __import__("random").Random(4)
    run = lt.prose(rng, "en", 11)  # k + window - 1 words
    rows = [(i, f"{lt.prose(rng, 'fr', 30)} {run} {lt.prose(rng, 'de', 25)}", "en", "s") for i in range(6)]
    got = QUERIES["op8_fingerprints"](spark, lt.write(tmp_path, rows)).toPandas()
    grams = [{x.split(":")[0] for x in f.split()} for f in got.fingerprint]
    assert all(a & b for a in grams for b in grams)


def test_vectors_against_all_pairs(spark, tables):
    ids, vecs = lt.vectors()
    got = QUERIES["op9_vectors"](spark, tables).toPandas().set_index("vec_id")
    ok = [i for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    c, links = lt.Components(ids), Counter()
    x = {i: np.array(vecs[i], np.float32).astype(float) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.95:
                c.join(a, b)
                links[a] += 1
                links[b] += 1
    assert sum(links.values()) > 50
    found = sum(min(got.n_links[i], links[i]) for i in ids)
    assert found >= 0.9 * sum(links.values()) and all(got.n_links[i] <= links[i] for i in ids)
    least = {}
    for i in ids:
        least[c.find(i)] = min(least.get(c.find(i), i), i)
    assert all(got.component_id[i] == least[c.find(i)] for i in ids)
    assert (got.kept == (got.index == got.component_id)).all()


def test_kept_hashes(spark, tables):
    rows = lt.documents() + lt.odd_documents()
    cover = lt.repeated_cover([r[1] for r in rows])
    got = QUERIES["op4_repeats"](spark, tables).toPandas().set_index("doc_id")
    assert sum(c.sum() for c in cover) > 5000
    for r, c in zip(rows, cover, strict=True):
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        assert got.kept_sha256[r[0]] == hashlib.sha256(raw[~c].tobytes()).hexdigest()
