"""Phrases, periodic runs and archives against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import llm_tables as lt
import numpy as np
import pyarrow as pa
import pytest

from scenaria.llm import periodic, phrases, warc
from scenaria.llm.catalog import QUERIES
from scenaria.llm.common import Scratch, prepare


# Phrases


def best_phrases(rows, top=2000, least=10):
    """(lang, rank, phrase, a, l, r, n, score) from rows (lang, text), counting everything."""
    counts, out = {}, []
    for lang, text in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower()):
            words = re.findall(rb"[^ \t]+", piece)
            for k in (1, 2, 3):
                c.update(zip(*(words[i:] for i in range(k)), strict=False))
    for lang, c in counts.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        dropped = {g for t, a in found.items() if len(t) == 3 for g in (t[:2], t[1:]) if 100 * a >= 50 * c[g]}
        scored = []
        for g, a in found.items():
            if g not in dropped:
                score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, b" ".join(g), c[g[:k]], c[g[k:]]))
        n = sum(a for g, a in c.items() if len(g) == 1)
        for i, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_texts(seed, n=300):
    """Few words, so that phrases repeat; set phrases, ties, a language with few texts and one without a name."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        words = [rng.choice(["a", "B", "c d", "e f g", "h", "i.", "j k", "é", "New  York\tcity", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60))]
        rows.append((lang, " ".join(words) if i % 50 else None))
    return [*rows, ("tiny", "one two. " * 9), ("tied", "x y z. " * 12 + "p q, " * 12 + "r s! " * 12), ("", "u v " * 11)]


@pytest.mark.parametrize("top", [3, 7, 2000])
def test_phrases_equal_counting_everything(spark, top):
    prepare(spark)
    rows = phrase_texts(top)
    docs = spark.createDataFrame([(r[0], r[1], 1) for r in rows], "lang string, text string, n int")
    got = sorted(tuple(r) for r in phrases.mine(docs, Scratch(spark, "phrases"), top=top).collect())
    assert got == best_phrases(rows, top)


def test_counts_beyond_64_bit_products(spark):
    df = spark.createDataFrame([(10**12, 3 * 10**12 + 1, 10**14)], "n long, l long, r long")
    got = df.select(phrases._score("n", ("l", "r")).alias("s")).collect()[0].s
    assert got == 1_000_000 * 10**24 // ((3 * 10**12 + 1) * 10**14)


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("piece", [1, 7, 40])
def test_long_texts_are_read_in_parts(monkeypatch, size, piece):
    monkeypatch.setattr(phrases, "SLICE", piece)
    monkeypatch.setattr(phrases, "CHUNK", 5)
    rng = random.Random(piece)
    texts = [" ".join(f"w{rng.randrange(9)}" + rng.choice(["", "", "", ".", " ", "\t"]) for _ in range(rng.randrange(90))) for _ in range(40)]
    slots = type("Slots", (), {"value": bytes([7]) * 65536})
    table = pa.table({"lang": ["en"] * len(texts), "text": [t.encode() for t in texts]})
    got = Counter()
    for b in phrases._counter(size, slots)(table.to_batches()):
        for r in b.to_pylist():
            got[r["phrase"]] += r["n"]
    want = Counter()
    for t in texts:
        for part in t.encode().split(b"."):
            w = part.split()
            want.update(b" ".join(g) for g in zip(*(w[i:] for i in range(size)), strict=False))
    assert got == want


# Periodic runs


def all_runs(words):
    """Every run by comparing the text with itself at every distance."""
    numbers: dict = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], int)
    out: dict = {}
    for q in range(1, len(w) // 4 + 1):
        edge = np.diff((w[:-q] == w[q:]).astype(int), prepend=0, append=0)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a + q >= max(6, 4 * q):
                out.setdefault((int(a), int(b - a + q)), q)
    return sorted((a, n, q) for (a, n), q in out.items())


def run_text(rng):
    words = [rng.randrange(rng.choice((1, 2, 3, 8, 60))) for _ in range(rng.choice((0, 1, 5, 6, 7, 40, 150, 400)))]
    for _ in range(rng.choice((0, 1, 3))):
        if len(words) > 20:
            a, q, n = rng.randrange(len(words)), rng.randint(1, len(words) // 4), rng.randint(1, len(words))
            for i in range(a, min(len(words), a + n)):
                words[i] = words[a + (i - a) % q]
    return b" ".join(b"w%d" % x for x in words)


@pytest.mark.parametrize("batch", [50, 200_000])
def test_runs_equal_all_distances(monkeypatch, batch):
    monkeypatch.setattr(periodic, "BATCH_WORDS", batch)
    rng = random.Random(batch)
    texts = [run_text(rng) for _ in range(300)]
    got = [(words, runs.tolist()) for words, runs in periodic.text_runs(texts, [""] * len(texts))]
    assert got == [(t.split(), [list(r) for r in all_runs(t.split())]) for t in texts]


def test_chance_matches_of_identifiers_do_no_harm(monkeypatch):
    monkeypatch.setattr(periodic, "_mix", lambda x: x % np.uint64(3))
    rng = random.Random(4)
    for t in [run_text(rng) for _ in range(60)]:
        [(_, runs)] = periodic.text_runs([t], [""])
        assert {tuple(r) for r in runs.tolist()} <= set(all_runs(t.split()))


def want_runs(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_query(spark, tmp_path):
    rows = lt.documents(n=200) + lt.odd_documents()[:9] + lt.odd_documents()[10:]
    rows += rows[:3] + [(None, "x y z " * 30, None, None), (None, None, None, None), (0, "same id " * 9, "en", "s")]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = QUERIES["op12_runs"](spark, lt.write(tmp_path, rows, extra=True)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((want_runs(r[0], r[1]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) >= 10


def test_a_very_long_text(spark):
    rng = random.Random(1)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    text = " ".join(["start", *unit * 300, "end"])
    docs = spark.createDataFrame([(1, text), (2, "a " * 7)], "doc_id long, text string")
    prepare(spark)
    assert sorted(tuple(r) for r in periodic.runs_of(docs).collect()) == [(1, 1, 300_000, 1000), (2, 0, 7, 1)]
    assert {r.doc_id: r.collapsed for r in periodic.collapse(docs).collect()} == {1: " ".join(["start", *unit, "end"]), 2: "a"}


# Archives


def want_records(rows):
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        f, raw = first.get(h or ""), (h or "").encode()
        again = f is not None and i != f
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [700, 6000, 10**7])
def test_records_read_back(spark, tmp_path, split):
    """Splits of some hundred bytes: records, headers and magic lie across them."""
    rows = lt.pages(n=25 if split < 1000 else 60)
    pages = spark.read.parquet(lt.write(tmp_path, [], extra=True, pages=rows) + "/pages.parquet").coalesce(1)
    prepare(spark)
    scratch = Scratch(spark, "archives")
    path = f"{scratch.root}/archives"
    warc.write(warc.records(pages, scratch), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = warc.read(spark, path, scratch, payloads=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    number = lambda x: None if x is None else int(x)
    assert sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got), key=repr) == want_records(rows)
    assert all(r.intact for r in got)
    assert all(warc.digest(bytes(r.payload)) == r.payload_digest for r in got if r.record_type == "response")
    assert {r.url for r in got} == {None, "http://a/é", "http://b%0D%0AX: y", "u"}


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.records(pages, Scratch(spark, "small"), least=3).orderBy("page_id").collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None), ("response", None), ("response", None), ("revisit", 3)]


def test_what_follows_a_broken_record_is_left_out(spark, tmp_path):
    record = lambda n, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "HTTP/1.1 200 OK\r\n\r\nx") + record(2, "not http") + "torn " + record(3, "y")).encode())
    (tmp_path / "b.warc").write_bytes(b"no magic at the start " + record(4, "z").encode())
    prepare(spark)
    got = warc.read(spark, str(tmp_path), Scratch(spark, "broken"))
    assert sorted((r.page_id, r.offset, r.payload_bytes) for r in got.collect()) == [("1", 0, 1), ("2", 109, None)]
