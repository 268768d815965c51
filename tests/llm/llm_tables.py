"""Small tables for the operators' tests, written as Parquet folders like the given ones."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

WORDS = {
    "en": "the of and to in that it was for on are with as his they at be this from have shore window thread".split(),
    "de": "der die und das nicht von sie ist des sich mit dem dass er es ein ich auf so eine straße grün".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au été garçon fenêtre".split(),
}
DOCUMENTS = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
)


def prose(rng, lang: str, n: int) -> str:
    # words of two or three pieces, so that passages rarely repeat by chance
    pieces = WORDS[lang]
    words = ["".join(rng.choices(pieces, k=rng.choice((1, 1, 2, 3)))) for _ in range(n)]
    for i in range(12, n, 13):
        words[i] += ".\n" if i % 2 else "."
    return " ".join(words)


def documents(seed: int = 1, n: int = 90) -> list[tuple]:
    """(doc_id, text, lang, source): a hot source, exact and near copies, shared passages, licence lines."""
    rng = random.Random(seed)
    rows = []
    shared = prose(rng, "en", 70)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = prose(rng, lang, rng.choice((3, 20, 60, 150, 300)))
        if i % 9 == 1:
            text = shared + " " + text
        if i % 11 == 2:
            text += "\nReleased under the MIT License."
        if i % 13 == 3:
            text += "\nThis work is licensed under the GNU General Public License, version 3."
        rows.append([i, text, lang, "hot" if i % 3 else f"s{i % 5}"])
    for i in range(5, n, 10):  # copies and copies with one word changed, early and late
        rows[i][1], rows[i][2] = rows[i - 4][1], rows[i - 4][2]
        words = rows[i - 3][1].split(" ")
        words[len(words) // 2] = "changed"
        rows[i + 1][1], rows[i + 1][2] = " ".join(words), rows[i - 3][2]
    return [tuple(r) for r in rows]


def odd_documents() -> list[tuple]:
    """Empty and blank texts, no letters, rare characters, one word, one very long text, ties."""
    rng = random.Random(7)
    long = prose(rng, "de", 30_000)
    return [
        (100, "", "en", "s1"),
        (101, None, "en", None),
        (102, " \n\t ", None, "hot"),
        (103, "12345 !!! ???", "en", "hot"),
        (104, "one", "en", "s1"),
        (105, "two words", None, "s2"),
        (106, "Çà  double  blanks and \x1c odd   ones\r\n", "fr", "s2"),
        (107, "a" * 5000, "en", "hot"),
        (108, "x y " * 400, "en", "hot"),
        (109, long, "de", "hot"),
        (110, "marker <|endoftext|> inside", "en", "s3"),
        (111, "日本語のテキスト 😀 emoji", None, None),
        (112, "MIT license, Apache License; gpl? general public license", "en", "s1"),
    ]


PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def pages(seed: int = 5, n: int = 60) -> list[tuple]:
    """(page_id, url, html): copies, empty and missing pages, missing ids, payloads that hold whole records."""
    rng = random.Random(seed)
    inner = lambda k: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:9>\r\nContent-Length: {k}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    pool = ["", None, "plain é\r\n\r\n", "WARC/1.0\r\n", "WARC/1.0\r\nno header\r\n\r\n", inner(41) + "\r\n\r\n", "\r\n\r\n".join([inner(41)] * 4)]
    pool += ["ends with " + inner(k) for k in range(38, 50)]  # some end just where the next record starts
    rows = [(i, rng.choice([None, "http://a/é", "http://b\r\nX: y"]), rng.choice(pool) if rng.random() < 0.7 else prose(rng, "en", 200)) for i in range(n)]
    return [*rows, *rows[:4], (None, None, rows[0][2]), (None, "u", "only here"), (None, "u", "only here"), (5, "u", "other page of a taken id")]


def write(path, rows: list[tuple], extra: bool = False, vectors=None, pages=()) -> str:
    """Writes documents, pages and embeddings; ``extra`` adds columns whose names the operators use themselves."""
    columns = list(zip(*pages, strict=True)) if pages else [[], [], []]
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, PAGES, strict=True)], schema=PAGES)
    if extra:
        for name in ("payload", "same", "first", "rows", "file", "block", "at", "value", "record_type", "refers_to"):
            table = table.append_column(name, pa.array([1] * len(pages), pa.int32()))
    pq.write_table(table, f"{path}/pages.parquet")
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    n_chars = [len(t) if t is not None else None for t in columns[1]]
    table = pa.table([pa.array(list(c), f.type) for c, f in zip([*columns, n_chars], DOCUMENTS, strict=True)], schema=DOCUMENTS)
    if extra:
        for name in ("t", "n", "k", "h", "l", "r", "a", "phrase", "rank", "start", "period", "_text", "_id", "chunk", "shard", "slot", "epoch", "score", "_src", "_raw", "spans", "length", "component", "part"):
            table = table.append_column(name, pa.array([1] * len(rows), pa.int32()))
    pq.write_table(table, f"{path}/documents.parquet")
    ids, vecs = vectors if vectors is not None else ([], [])
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    table = pa.table([pa.array(ids, pa.int64()), pa.array(vecs, kinds.field(1).type), pa.array([0] * len(ids), pa.int32())], schema=kinds)
    if extra:
        for name in ("k", "vec", "copies", "component", "links", "code0"):
            table = table.append_column(name, pa.array([1] * len(ids), pa.int32()))
    pq.write_table(table, f"{path}/embeddings.parquet")
    return str(path)


def vectors(seed: int = 3):
    """Clusters of near vectors, exact copies, and vectors that must link with nothing."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    vecs = [list(map(float, c + rng.standard_normal(16) * 0.05)) for c in centres for _ in range(6)]
    vecs += [vecs[0], vecs[0], [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, vecs[3][:8], [x * 1000 for x in vecs[5]]]
    return list(range(len(vecs))), vecs


def sql(path: str, statement: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con.execute(statement).df()


def same_rows(got: pd.DataFrame, want: pd.DataFrame) -> None:
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def plain(f):
        # integers that pandas keeps as floats next to missing values count as integers
        value = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
        return sorted((tuple(map(value, r)) for r in f[cols].astype(object).values.tolist()), key=repr)

    assert plain(got) == plain(want)


def fold(doc_id, k: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % k


class Components:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)


def shingle_set(text, size: int = 3) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, size: int = 3, percent: int = 90) -> dict:
    """Row number -> numbers of its component, by comparing all pairs."""
    sets = [shingle_set(r[1], size) for r in rows]
    c = Components(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                c.join(i, j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(c.find(i), []).append(i)
    return {i: g for g in groups.values() for i in g}


def repeated_cover(texts, length: int = 200) -> list[np.ndarray]:
    """For each text, which of its bytes a string covers that also starts elsewhere."""
    raws = [(t or "").encode() for t in texts]
    seen: dict = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            s = r[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for r in raws:
        edge = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        out.append(np.cumsum(edge[:-1]) > 0)
    return out
