"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

Writing. One record per page, in the text source's files with the record separator as line separator: a
``response`` with an HTTP header and the payload, or a ``revisit`` with the HTTP header alone (whose
Content-Length and whose WARC-Payload-Digest are the full payload's) that refers to the response. Among
records whose payloads of ``least`` bytes or more are equal, the one with the smallest page_id is the
response. Only the payloads' digests are shuffled for this; the list of those that occur more than once is
broadcast up to BROADCAST rows and joined beyond, where Spark splits a hot payload.

Reading. The text source splits the archives at the magic ``WARC/1.0``, wherever it stands, over as many
tasks as the files have splits. Each task emits, for every magic, the offset of the candidate record and of
its successor, worked out from the candidate's own Content-Length; magic that no record header follows has
none. Offsets count from the split's first magic; sums over the splits of a file make them absolute. Within
a split the task follows successors to where they leave it, so each candidate also has an exit. The exits
that are candidates themselves, and the start of each file, are the nodes of pointer jumping: in each round
the reached nodes reach what their pointers say, and every pointer takes its target's pointer. A split is
entered at one place at most, and the candidates on the way from there are the records. All other magic
stands inside a payload. Payloads that hold magic are spread over several rows, and put together in a
second scan that is made only if there are such payloads.

Defined results: a null html is an empty payload; a null page_id is written as an empty one and read as null,
and refers to the smallest page_id of equal payloads, if there is one; rows that repeat the smallest page_id
with its payload are responses all of them; line ends in a url are percent-encoded, a null url is left out;
empty tables give empty archives; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

MAGIC = b"WARC/1.0\r\n"
#: Between records; the text source writes it after each one.
SEPARATOR = "\r\n\r\n"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
#: Rows of the list of repeated payloads up to which it is broadcast (some 60 bytes each).
BROADCAST = 100_000
#: Longest record header that is looked for.
HEADER = 65_536


def base32(hexadecimal: Column) -> Column:
    """RFC 4648 base32 of a hexadecimal string whose length is a multiple of 5."""
    value = lambda i: F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
    digit = lambda v, k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(v, 5 * (3 - k)).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(digit(value(i), k) for i in range(8) for k in range(4)))


def records(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every page."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    plain = pages.select("page_id", "url", payload.alias("payload"))
    plain = plain.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("same", F.unhex(F.sha2("payload", 256)))
    large = plain.filter(F.col("payload_bytes") >= least).select("page_id", "same")
    groups = large.groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.min("page_id").alias("first"))
    groups = scratch.save(groups.filter("rows > 1 AND first IS NOT NULL").select("same", "first"), "repeated-payloads")
    few = groups.count() <= BROADCAST
    out = plain.join(F.broadcast(groups) if few else groups, "same", "left")
    revisits = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return out.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        base32(F.sha1("payload")).alias("payload_digest"),
        F.when(revisits, REVISIT).otherwise(RESPONSE).alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def write(recs: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the records as uncompressed WARC 1.0 files."""
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    revisit = F.col("record_type") == REVISIT
    held = F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        name("page_id"),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.length(http) + held).cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    recs.select(F.concat(head, http, body).alias("value")).write.option("lineSep", SEPARATOR).text(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$", re.M)
CANDIDATE = (
    "file string, block long, at long, size long, file_size long, head long, next long, exit long, record_type string, page_id string,"
    " url string, refers_to string, payload_at long, payload_bytes long, declared string, digest string"
)


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in columns.split(","))])


def _parse(value: bytes) -> dict | None:
    """The record header that follows a magic, or None if none does.

    head: bytes from the record's start to its block; next: to its successor; payload_at: to its payload.
    """
    end = value.find(b"\r\n\r\n", 0, HEADER)
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(value[:end])}
    length = fields.get(b"content-length", b"")
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    if not (length.isdigit() and len(length) < 19 and kind):
        return None
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    name = lambda k: (text(k) or "").strip("<>").removeprefix(ID) or None
    head = len(MAGIC) + end + 4
    out = {"head": head, "next": head + int(length) + len(SEPARATOR), "record_type": kind, "page_id": name(b"warc-record-id"), "url": text(b"warc-target-uri"), "refers_to": name(b"warc-refers-to"), "declared": (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None}
    block = value[end + 4 : end + 4 + min(int(length), HEADER)]
    http = block.find(b"\r\n\r\n")
    if http >= 0:
        inner = {k.lower(): v for k, v in _FIELD.findall(block[:http])}
        size = inner.get(b"content-length", b"")
        out["payload_at"] = head + http + 4
        out["payload_bytes"] = int(size) if size.isdigit() and len(size) < 19 else None
        if kind != REVISIT:
            # what the block holds decides
            out["payload_bytes"] = int(length) - http - 4
            payload = value[end + 4 + http + 4 : end + 4 + int(length)]
            if len(payload) == out["payload_bytes"]:
                out["digest"], out["payload"] = digest(payload), payload
    return out


def _exits(rows: list[dict]) -> None:
    """Where each candidate's chain leaves the split, as offsets from its first row; None where it ends inside."""
    if not rows:
        return
    beyond = rows[-1]["at"] + rows[-1]["size"]  # the next magic after the split, or the file's end
    exits: dict[int, int | None] = {}
    for r in reversed(rows):
        if r.get("next") is not None:
            to = r["at"] + r["next"]
            exits[r["at"]] = r["exit"] = exits.get(to) if to < beyond else to


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """Rows of the text source with offsets: file, block, offset of the magic before, file size, value."""
    key, at = None, 0
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("file", "block", "file_size", "value")]
        for file, block, file_size, value in zip(*columns, strict=True):
            if (file, block) != key:
                key, at = (file, block), 0
            yield file, block, at, file_size, value
            at += len(value) + len(MAGIC)


def _candidates(columns: str):
    """One row per magic; rows of a split stay together and in order."""

    def run(batches):
        key, rows, schema = None, [], _schema(columns)

        def batch():
            _exits(rows)
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for file, block, at, file_size, value in _rows(batches):
            if (file, block) != key:
                if rows:
                    yield batch()
                key, rows = (file, block), []
            # The magic stands before the value; a file's first value is what stands before its first magic.
            found = (_parse(value) if at or block else None) or {}
            if "payload" not in schema.names:
                found.pop("payload", None)
            rows.append({"file": file, "block": block, "at": at, "size": len(value) + len(MAGIC), "file_size": file_size, **found})
        if rows:
            yield batch()

    return run


def _marker(columns: str):
    """Follows the chain of one split from where it is entered; each row gets the record that it belongs to."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        at, owner, out = rows[0]["entry"], None, []
        for r in rows:
            if r["at"] == at and r["next"] is not None:
                owner, at = r["base"] + r["at"], at + r["next"]
            out.append({**r, "place": r["base"] + r["at"], "owner": owner})
        return pa.Table.from_pylist(out, schema=_schema(columns))

    return run


def _joiner(table: pa.Table) -> pa.Table:
    """One payload from the rows that it is spread over."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    first = rows[0]
    raw = b"".join(MAGIC + r["value"] for r in rows)
    payload = raw[first["payload_at"] : first["payload_at"] + first["payload_bytes"]]
    found = {"file": first["file"], "owner": first["owner"], "joined": payload, "joined_digest": digest(payload)}
    return pa.Table.from_pylist([found], schema=_schema("file string, owner long, joined binary, joined_digest string"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The archives' rows between magics: file, block (the split's start), file_size and value."""
    m = F.col("_metadata")
    rows = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return rows.select(
        m["file_path"].alias("file"), m["file_block_start"].alias("block"), m["file_size"].alias("file_size"), F.col("value").cast("binary").alias("value")
    )


def reached(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes (file, place, to) that pointers lead to from the start of their file, by pointer jumping."""
    start = len(MAGIC)
    found = nodes.filter(F.col("place") == start).select("file", "place")
    ends = nodes.select(F.col("file").alias("f"), F.col("place").alias("p"))
    jumps = nodes.join(ends, (nodes["file"] == ends["f"]) & (nodes["to"] == ends["p"]), "left_semi").select("file", "place", "to")
    jumps = scratch.save(jumps, "jumps")
    while jumps.take(1):
        more = jumps.join(found, ["file", "place"], "left_semi").select("file", F.col("to").alias("place"))
        found = scratch.save(found.unionByName(more).distinct(), "reached")
        then = jumps.select(F.col("file").alias("f"), F.col("place").alias("p"), F.col("to").alias("then"))
        jumps = jumps.join(then, (jumps["file"] == then["f"]) & (jumps["to"] == then["p"]))
        jumps = scratch.save(jumps.select("file", "place", F.col("then").alias("to")), "jumps")
    return found


def read(spark: SparkSession, path: str, scratch: Scratch, payloads: bool = False) -> DataFrame:
    """The archives' records, one row each: file, offset, length, record_type, page_id, url, refers_to,
    payload_bytes, payload_digest and intact (the digest is the declared one); with ``payloads`` also payload.

    A revisit's payload_bytes and payload_digest are those that it declares; its payload is null.
    """
    columns = CANDIDATE + ", payload binary" * payloads
    rows = scratch.save(scan(spark, path).mapInArrow(_candidates(columns), columns), "candidates")

    # Offsets in the file: what the splits before hold.
    order = Window.partitionBy("file").orderBy("block")
    splits = rows.groupBy("file", "block").agg(F.sum("size").alias("total"), F.max("file_size").alias("file_size"))
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = scratch.save(splits.withColumn("base", before), "splits")
    wrong = splits.groupBy("file").agg((F.sum("total") - len(MAGIC) - F.max("file_size")).alias("off")).filter("off <> 0").take(1)
    if wrong:
        raise ValueError(f"splits do not add up to the file: {wrong[0]}")

    base = splits.select("file", "block", "base")
    chains = rows.filter(F.col("next").isNotNull()).select("file", "block", "at", "exit").join(base, ["file", "block"])
    chains = chains.select("file", "block", (F.col("base") + F.col("at")).alias("place"), (F.col("base") + F.col("exit")).alias("to"))
    targets = chains.filter(F.col("to").isNotNull()).select("file", F.col("to").alias("place")).unionByName(splits.select("file", F.lit(len(MAGIC)).cast("long").alias("place"))).distinct()
    nodes = scratch.save(chains.join(targets, ["file", "place"], "left_semi"), "nodes")
    entered = nodes.join(reached(nodes.drop("block"), scratch), ["file", "place"], "left_semi").select("file", "block", "place")
    splits = scratch.save(splits.join(entered, ["file", "block"], "left").withColumn("entry", F.col("place") - F.col("base")).drop("place"), "entries")

    marked = columns + ", place long, owner long"
    held = rows.join(splits.select("file", "block", "base", "entry"), ["file", "block"])
    held = scratch.save(held.groupBy("file", "block").applyInArrow(_marker(marked), marked), "rows")
    found = held.filter(F.col("owner") == F.col("place"))

    # Payloads that hold magic: their rows, in a second scan of the splits where they lie.
    found = found.withColumn("joined", F.lit(None).cast("binary")).withColumn("joined_digest", F.lit(None).cast("string"))
    broken = (F.col("record_type") != REVISIT) & F.col("digest").isNull() & F.col("payload_at").isNotNull()
    spread = scratch.save(found.filter(broken).select("file", "owner", "payload_at", "payload_bytes", "next"), "spread")
    if spread.take(1):
        last = held.groupBy("file", "block").agg(F.max("owner").alias("last"))
        carry = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        carry = last.select("file", "block", carry.alias("carry"))
        owned = held.select("file", "block", "at", "place", "owner").join(carry, ["file", "block"])
        owned = owned.withColumn("owner", F.coalesce("owner", "carry")).drop("carry").join(spread, ["file", "owner"])
        owned = scratch.save(owned.filter(F.col("place") < F.col("owner") + F.col("next")).drop("next"), "spread-rows")
        where = owned.select("file", "block").distinct()
        again = scan(spark, path)
        if where.count() <= BROADCAST:
            again = again.join(F.broadcast(where), ["file", "block"], "left_semi")  # keeps the order of the rows
        values = "file string, block long, at long, value binary"
        parts = again.select("file", "block", "file_size", "value").mapInArrow(_values(values), values).join(owned, ["file", "block", "at"])
        whole = parts.groupBy("file", "owner").applyInArrow(_joiner, "file string, owner long, joined binary, joined_digest string")
        found = found.drop("joined", "joined_digest").join(scratch.save(whole, "joined"), ["file", "owner"], "left")

    worked_out = F.coalesce("digest", "joined_digest")
    out = found.select(
        "file",
        (F.col("place") - len(MAGIC)).alias("offset"),
        (F.col("next") - len(SEPARATOR)).alias("length"),
        "record_type",
        "page_id",
        "url",
        "refers_to",
        "payload_bytes",
        F.when(F.col("record_type") == REVISIT, F.col("declared")).otherwise(worked_out).alias("payload_digest"),
        ((F.col("record_type") == REVISIT) | (F.col("declared") == worked_out)).alias("intact"),
        *([F.coalesce("payload", "joined").alias("payload")] if payloads else []),
    )
    return out


def _values(columns: str):
    def run(batches):
        rows = []
        for file, block, at, _, value in _rows(batches):
            rows.append({"file": file, "block": block, "at": at, "value": value})
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(columns))
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=_schema(columns))

    return run
