"""WARC archives: one gzip member per record, written by tasks, and read back in order by incremental decompression."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import discard, durable, if_few, in_batches, row_ids, shared_dir, unused

#: Payloads of fewer bytes are stored again and again: a reference would take as much room.
LEAST_SHARED = 100
#: An archive that has reached so many bytes is closed, and the task begins another.
ROLL = 256 << 20
#: Bytes asked of a file, and most bytes taken from the decompressor, at once.
CHUNK = 1 << 16
#: A record's headers are no longer.
MOST_HEADER = 1 << 20
#: Rows and payload bytes of a batch that the reader hands on.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
VERSION = b"WARC/1.1"
#: A gzip member's first bytes (fixed values of the format).
START = b"\x1f\x8b\x08"
NOTHING = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload_ok", "block_ok", "payload")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string"
RECORD = "file string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload_ok boolean, block_ok boolean, payload binary, error string"


def _storage(uri: str):
    """The file system of a folder or file and the path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _header_value(text: str) -> str:
    """Controls and spaces, which would end or break a header line, as %XX of their UTF-8 bytes; all else as it is."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as one gzip member; fields that are None are left out."""
    lines = [VERSION, *(f"{k}: {_header_value(v)}".encode("utf-8", "replace") for k, v in fields if v is not None), f"Content-Length: {len(block)}".encode()]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _sha256(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def record(row: dict, date: str) -> bytes:
    """The record of a row: response with its payload, or revisit with the headers of the answer alone."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + row["payload"]
    return member(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Date", date),
            ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
            ("WARC-Block-Digest", _sha256(block)),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def write_archives(records: DataFrame, folder: str, date: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes records(record_id, target_uri, payload, payload_bytes, payload_digest, refers_to) as archives below folder, and returns their index.

    A row with refers_to is a revisit and needs no payload. The index (INDEX) has a row for each record, and is itself
    a written table: it alone says which archives count. A task that is run again writes archives of other names, and
    those of lost or failed tries are in no index (a failed one deletes its own where it can). Each archive starts with
    a warcinfo record and is closed once it has `roll` bytes, so a task that reads one has bounded work. Memory is a
    batch of rows and one compressed record. A null target_uri leaves the header out; an empty table writes no archive.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder.rstrip("/")
    names = ["record_id", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches):
        storage, at = _storage(folder)
        numbers = row_ids()
        out = name = None
        written, done = 0, []
        try:
            for batch in batches:
                rows = []
                for row in (dict(zip(names, x)) for x in zip(*(batch.column(k).to_pylist() for k in names))):
                    if out is None:
                        storage.create_dir(at, recursive=True)
                        name = f"{next(numbers):012d}-{uuid.uuid4().hex}.warc.gz"
                        out, written = storage.open_output_stream(f"{at}/{name}", compression=None), 0
                        done.append(f"{at}/{name}")
                        start = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(start)
                        written += len(start)
                    data = record(row, date)
                    out.write(data)
                    rows.append((f"{folder}/{name}", written, len(data), row["record_id"], "response" if row["refers_to"] is None else "revisit", row["target_uri"], row["payload_digest"]))
                    written += len(data)
                    if written >= roll:
                        out.close()
                        out = None
                yield _batch(rows, INDEX)
            if out is not None:
                out.close()
        except BaseException:
            with contextlib.suppress(Exception):
                if out is not None:
                    out.close()
                for path in done:
                    storage.delete_file(path)
            raise

    return durable(in_batches(records.select(*names), run, INDEX))


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


class Damaged(ValueError):
    """What is wrong with a record."""


class Source:
    """The bytes of an archive in order; bytes that a member didn't need can be given back."""

    def __init__(self, stream):
        self.stream, self.held, self.place = stream, b"", 0

    def take(self) -> bytes:
        """The next bytes, at most CHUNK or what was given back; none at the end."""
        out, self.held = self.held or self.stream.read(CHUNK), b""
        self.place += len(out)
        return out

    def give_back(self, data: bytes) -> None:
        self.held = data + self.held
        self.place -= len(data)


class Member:
    """The content of the gzip member at a source's place, decompressed as it is asked for: never more than CHUNK ahead."""

    def __init__(self, source: Source):
        self.source, self.z, self.held, self.waiting = source, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        """Decompresses some more; False at the member's end."""
        while not self.z.eof:
            data = self.waiting or self.source.take()
            if not data:
                raise Damaged("the archive ends inside a record")
            try:
                out = self.z.decompress(data, CHUNK)
            except zlib.error as e:
                self.waiting = b""
                self.source.give_back(data)
                raise Damaged(f"not a gzip member: {e}") from None
            self.waiting = self.z.unconsumed_tail
            if self.z.eof:
                self.source.give_back(self.z.unused_data)
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes up to the mark, which goes."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > most:
                raise Damaged("headers without an end")
            if not self.more():
                raise Damaged("the member ends inside the headers")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self.more():
                raise Damaged("the member is shorter than its Content-Length")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        """What is left, if it is little."""
        while len(self.held) <= 4 and self.more():
            pass
        return bytes(self.held)

    def skip(self, start: int) -> None:
        """Goes to the end of the member, which began at start; if it is damaged, to the next place that looks like a start, or the end."""
        try:
            while self.more():
                self.held.clear()
            return
        except Damaged:
            self.source.give_back(self.waiting)
        tail = b""
        while data := self.source.take():
            tail = tail[-2:] + data
            first = max(0, start + 1 - (self.source.place - len(tail)))
            if (at := tail.find(START, first)) >= 0:
                self.source.give_back(tail[at:])
                break


def _fields(header: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case; a line that starts with white space continues the one before."""
    out, name = {}, None
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def _digest(text: str | None) -> str | None:
    """The bare lower-case hex of a declared SHA-256 digest; None for others."""
    kind, _, value = (text or "").partition(":")
    return value.lower() if kind.lower() == "sha256" and re.fullmatch("[0-9A-Fa-f]{64}", value) else None


def read_record(m: Member, with_payload: bool) -> dict:
    """The member's record, in the columns of RECORD but for file, offset and length. Raises Damaged."""
    head = m.until(b"\r\n\r\n", MOST_HEADER)
    if not re.match(rb"WARC/1\.[01](\r\n|$)", head):
        raise Damaged("not a WARC record")
    fields = _fields(head)
    n = _whole_number(fields.get("content-length"))
    if n is None:
        raise Damaged("no Content-Length")
    kind = fields.get("warc-type", "")
    http = fields.get("content-type", "").lower().startswith("application/http")
    block, payload, answer, kept, size = hashlib.sha256(), hashlib.sha256(), None if http else b"", [], 0
    before = b""  # bytes of an HTTP answer's headers so far
    for part in m.exactly(n):
        block.update(part)
        if answer is None:
            before += part
            if (at := before.find(b"\r\n\r\n")) < 0:
                if len(before) > MOST_HEADER:
                    raise Damaged("an answer's headers without an end")
                continue
            answer, part = before[:at], before[at + 4 :]
        payload.update(part)
        size += len(part)
        if with_payload:
            kept.append(part)
    if m.rest() != b"\r\n\r\n":
        raise Damaged("the record doesn't end with its Content-Length")
    declared, own = _digest(fields.get("warc-payload-digest")), kind != "revisit"
    if not own and answer:
        size = _whole_number(_fields(answer).get("content-length")) if http else None
    block_digest = _digest(fields.get("warc-block-digest"))
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return {
        "record_type": kind,
        "record_id": bare("warc-record-id"),
        "target_uri": bare("warc-target-uri"),
        "date": fields.get("warc-date"),
        "refers_to": bare("warc-refers-to"),
        "payload_digest": payload.hexdigest() if own else declared,
        "payload_bytes": size,
        "payload_ok": None if declared is None or not own else declared == payload.hexdigest(),
        "block_ok": None if block_digest is None else block_digest == block.hexdigest(),
        "payload": b"".join(kept) if with_payload and own else None,
        "error": None,
    }


def read_archive(stream, with_payload: bool = True) -> Iterator[dict]:
    """Every record of an archive in order, with offset and length (of the compressed member).

    A damaged one gives a row with error alone, and reading goes on at the next place that looks like a member's start.
    """
    source = Source(stream)
    while data := source.take():
        source.give_back(data)
        start, m = source.place, Member(source)
        try:
            found = read_record(m, with_payload)
        except Damaged as e:
            m.skip(start)
            found = dict.fromkeys(NOTHING) | {"error": str(e)}
        yield found | {"offset": start, "length": source.place - start}


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """files(file) to the records of these archives (RECORD), one row per record or damaged place.

    Each archive is read once, front to back, by one task, in memory of one record and a batch of rows. payload is the answer's body (the block itself where it is no HTTP answer), null for a revisit or
    without with_payload; payload_digest is computed from it, and for a revisit is the declared one, as payload_bytes
    is the answer's Content-Length there. payload_ok and block_ok say whether the declared SHA-256 digests hold (null:
    none declared). Null files are left out, one named twice is read twice; an empty table gives no rows.
    """
    fields = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                storage, at = _storage(file)
                rows, size = [], 0
                with storage.open_input_stream(at, compression=None, buffer_size=0) as stream:
                    for found in read_archive(stream, with_payload):
                        rows.append(tuple((found | {"file": file})[k] for k in fields))
                        size += len(found["payload"] or b"")
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(rows, RECORD)
                            rows, size = [], 0
                yield _batch(rows, RECORD)

    every = files.select("file").where("file IS NOT NULL").distinct()
    return in_batches(files.select("file").where("file IS NOT NULL"), run, RECORD)


def with_revisited(records: DataFrame) -> DataFrame:
    """Records as read with payloads; a revisit gets the payload of the response it refers to (by record id; null if there is none, or its digest differs)."""
    responses = records.where("record_type = 'response' AND payload_ok").groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest")).agg(F.any_value("payload").alias("_payload"))
    joined = records.join(responses, ["refers_to", "payload_digest"], "left")
    return joined.select(*(c if c != "payload" else F.coalesce("payload", F.when(F.col("record_type") == "revisit", F.col("_payload"))).alias("payload") for c in records.columns))


def shared_payloads(pages: DataFrame, key: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to (null for a response) to pages; a null payload is empty.

    Of rows with equal payloads of `least` bytes or more, those with the smallest key are responses, the others refer
    to it; rows that share the smallest key are all responses, null keys come last. Digests are counted before they
    are shuffled, so a payload that a third of all rows have sends a row for each task; only digests of several rows
    meet the pages again, broadcast if they are few by count, else in a join that Spark may split at hot ones.
    """
    digest, size, first, n = (unused(k, pages.columns) for k in ("payload_digest", "payload_bytes", "_first", "_n"))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.withColumns({digest: F.sha2(body, 256), size: F.octet_length(body).cast("long")})
    shared = rows.where(F.col(size) >= least).groupBy(digest).agg(F.min(key).alias(first), F.count("*").alias(n)).where(f"{n} > 1").drop(n)
    joined = rows.join(if_few(durable(shared)), digest, "left")
    refers = F.when(F.col(first).isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col(first))), F.col(first))
    return joined.select(*pages.columns, F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), refers.alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """pages(page_id, url, html) written as archives below folder (by default a new one in the shared folder); their index.

    One record per row; its id is urn:page:<page_id> (a null page_id: urn:page: alone, so such rows share an id). Extra
    columns are ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = shared_payloads(pages.select("page_id", "url", "html"), "page_id", "html")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    revisit = F.col("refers_to").isNotNull()
    records = rows.select(
        name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(~revisit, F.coalesce(F.col("html").cast("binary"), F.lit(b""))).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, name(F.col("refers_to"))).alias("refers_to"),
    )
    return write_archives(records, folder, roll=roll)


def pages_of(records: DataFrame) -> DataFrame:
    """The pages' records as read: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id). A record whose digests don't hold, or that could not be read, stops the job: an archive is damaged."""
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    sound = F.col("error").isNull() & F.coalesce(F.col("block_ok"), F.lit(True)) & F.coalesce(F.col("payload_ok"), F.lit(True))
    checked = F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), F.col("file"), F.lit(" at "), F.col("offset").cast("string"))))
    pages = records.where("record_type IS NULL OR record_type IN ('response', 'revisit')")
    return pages.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), number(F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) through archives: written, read back, verified. One row per row (see archive_pages, pages_of).

    Null html is empty; texts of any length are one record; ties and repeated rows as in shared_payloads; an empty
    table gives no rows.
    """
    index = archive_pages(pages)
    files = durable(index.select("file").distinct())
    discard(index)
    # an archive is a task's work; ranges of names deal them out evenly, where hashes would put some together
    return pages_of(read_archives(files.repartitionByRange(max(1, files.count()), "file"), with_payload=False))
