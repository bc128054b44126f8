"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Each record is a gzip member of its own. A record with a payload of at least ``LEAST`` bytes that another
has too is a revisit of the one with the smallest id. The reader checks each member and each record's block
digest and length; after a failed check it searches for the next member (or, in plain archives, the next
version line) that can be read, goes on from there, and logs the gap in bytes with the reason. Records that
such a search found are marked.

Null html is an empty payload; null ids come after all others, and where all of a group are null none is a
revisit. Repeated rows with the smallest id are all responses. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, join_counted, make_dir, materialize, new_path
from .tokens import each_file, filesystem

LEAST = 100
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"


def urn(page_id, place: str = "") -> str:
    """The id of a record: its page, of any type or null, and its place in the archives, so that repeated pages differ."""
    told = "" if page_id is None else "=" + quote(str(page_id), safe="")
    return f"<urn:page:{told}{':' + place if place else ''}>"


def page_of(name: str | None) -> str | None:
    """The page that an id of a record names, as text."""
    told = (name or "").removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return unquote(told[1:]) if told.startswith("=") else None


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, digest: str, place: str = "0-0") -> bytes:
    """A whole record in WARC/1.1, not compressed. A revisit has no payload but tells the length and digest of it, and the page it refers to."""
    block = payload if kind == "response" else b""
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", urn(page_id, place)), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        head.insert(3, ("WARC-Refers-To", urn(refers_to)))
        head.insert(4, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Damaged(ValueError):
    pass


#: Bytes of a header and of a record at most; longer ones count as damaged, which bounds what a reader holds.
MOST_HEADER, MOST_RECORD = 1 << 16, 1 << 28
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: A blank line and the version line of the record after it.
NEXT = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")


def header(data: bytes | bytearray, at: int, end: int) -> tuple[dict, int]:
    """The fields of a record's header between two places, and the length that it states for its block."""
    try:
        lines = bytes(data[at:end]).decode().split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(head["content-length"])
    except (ValueError, KeyError) as e:
        raise Damaged("bad header") from e
    if not 0 <= length <= MOST_RECORD:
        raise Damaged("wrong length")
    return head, length


def agrees(head: dict, block: bytes) -> bool:
    """Whether a block has the digest that its header states, if it states one."""
    want = head.get("warc-block-digest", "")
    return not want.startswith("sha256:") or hashlib.sha256(block).hexdigest() == want[7:]


def parse(data: bytes) -> dict:
    """The one record of plain bytes. Raises Damaged if a check fails."""
    if not VERSION_LINE.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", 0, MOST_HEADER)
    if end < 0:
        raise Damaged("header without end")
    head, length = header(data, 0, end)
    stop = end + 4 + length
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("wrong length")
    if stop + 4 != len(data):
        raise Damaged("more than a record in a member")
    block = bytes(data[end + 4 : stop])
    if not agrees(head, block):
        raise Damaged("wrong digest")
    return head | {"block": block}


class Window:
    """The part of a stream that is held: from a place that moves on."""

    def __init__(self, stream: io.BufferedIOBase, chunk: int):
        self.stream, self.chunk, self.data, self.base, self.over = stream, chunk, bytearray(), 0, False

    def more(self) -> bool:
        got = self.stream.read(self.chunk)
        self.data += got
        self.over = not got
        return not self.over

    def has(self, n: int) -> bool:
        """Whether n bytes are held, after reading as many as there are."""
        while len(self.data) < n and not self.over:
            self.more()
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.base += n


def from_member(w: Window) -> tuple[dict | None, str, int]:
    """The record of the gzip member at the window's start, else the reason; and the bytes of the member that are known, 0 if its end is not."""
    d, out, fed, size = zlib.decompressobj(31), [], 0, 0
    try:
        while not d.eof:
            if fed == len(w.data) and not w.more():
                return None, "member cut off", 0
            out.append(d.decompress(bytes(w.data[fed : fed + w.chunk])))
            size += len(out[-1])
            fed = min(len(w.data), fed + w.chunk)
            if size > MOST_RECORD + MOST_HEADER:
                return None, "wrong length", 0
    except zlib.error:
        return None, "bad member", 0
    n = fed - len(d.unused_data)
    try:
        return parse(b"".join(out)), "", n
    except Damaged as e:  # the member is whole: what is in it is no part of the archive's own chain
        return None, str(e), n


def from_plain(w: Window) -> tuple[dict | None, str, int]:
    """The same of the record, not compressed, at the window's start.

    Where its length holds, a damaged block is passed over whole, with all that looks like a record in it. A
    length is given up as soon as the block up to a later version line has the header's digest.
    """
    end = w.data.find(b"\r\n\r\n", 0, MOST_HEADER)
    while end < 0 and len(w.data) < MOST_HEADER and w.more():
        end = w.data.find(b"\r\n\r\n", 0, MOST_HEADER)
    if end < 0:
        return None, "header without end", 0
    try:
        head, length = header(w.data, 0, end)
    except Damaged as e:
        return None, str(e), 0
    start, stop, seen = end + 4, end + 4 + length, end + 4
    told = "sha256:" in head.get("warc-block-digest", "")
    while len(w.data) < stop + 4 and not w.over:
        w.more()
        for m in NEXT.finditer(w.data, seen, min(len(w.data), stop)) if told else ():
            seen = m.end()
            if agrees(head, bytes(w.data[start : m.start()])):
                return None, "wrong length", m.end()
    if w.data[stop : stop + 4] != b"\r\n\r\n":
        return None, "wrong length", 0
    block = bytes(w.data[start:stop])
    if agrees(head, block):
        return head | {"block": block}, "", stop + 4
    # the block is broken; its end is sure where another record or nothing follows
    sure = not w.has(stop + 5) or w.has(stop + 9) and w.data.startswith(b"WARC/", stop + 4)
    return None, "wrong digest", stop + 4 if sure else 0


def salvage(stream: io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[tuple[str, object]]:
    """("record", header and block) and ("gap", (start, end, reason)) of an archive, in order.

    Holds a record of MOST_RECORD bytes at most and a chunk, not the archive. A broken record whose end is
    known is a gap up to there; else the search goes on behind its first byte, and a record that the search
    found, instead of the end of the one before it, has "resynced" set in its header: it may have lain in
    the block of the broken one.
    """
    w = Window(stream, chunk)
    gap, reason, searched = None, "", False
    while w.has(1):
        w.has(16)
        if w.data.startswith(MAGIC):
            got, why, n = from_member(w)
        elif VERSION_LINE.match(w.data):
            got, why, n = from_plain(w)
        else:
            got, why, n = None, "no record", 0
        if got is not None:
            if gap is not None:
                yield "gap", (gap, w.base, reason)
                gap = None
            yield "record", (got | {"resynced": "1"}) if searched else got
            searched = False
        elif gap is None:
            gap, reason = w.base, why
        if n:
            w.skip(n)
            continue
        searched = True
        # the next place where a member or a version line could begin
        at = 1
        while True:
            spots = [x for x in (w.data.find(MAGIC, at), w.data.find(b"WARC/1.", at)) if x >= 0]
            if spots:
                w.skip(min(spots))
                break
            w.skip(max(at, len(w.data) - 8))
            at = 0
            if not w.more():
                w.skip(len(w.data))
                break
    if gap is not None:
        yield "gap", (gap, w.base, reason)


def decide(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", least: int = LEAST) -> DataFrame:
    """A row for each row of pages: _id, _url, _html, _digest, _kind, _refers.

    First ids come from ids, digests and lengths alone. Only payloads that occur twice or more are looked up,
    and copies of the commonest ones stay spread over all tasks.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    url = F.col(f"`{url_col}`") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), url.alias("_url"), html.alias("_html"), F.sha2(html, 256).alias("_digest"))
    long = F.octet_length("_html") >= least
    firsts = rows.where(long).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    j = join_counted(rows, materialize(firsts, "firsts", "fewer"), "_digest", how="left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return j.select("_id", "_url", "_html", "_digest", F.when(again, "revisit").otherwise("response").alias("_kind"), F.when(again, F.col("_first")).alias("_refers"))


def write_archives(decided: DataFrame, path: str) -> DataFrame:
    """Write an archive for each task under path; return the manifest: file, n_records."""
    bound_batches(decided.sparkSession)
    make_dir(decided.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, n, sink = f"{path}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            if sink is None:
                fs, local = filesystem(name)
                sink = fs.open_output_stream(local, compression=None)
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sink.write(member(record(page, url, html, kind, refers, digest, f"{part}-{n}")))
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

    rows = decided.select("_id", "_url", F.col("_html").cast("binary").alias("_html"), "_digest", "_kind", "_refers")
    return materialize(rows.mapInArrow(run, "file string, n_records long"), "archives")


READ_SCHEMA = "file string, record_id string, page string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary, resynced boolean, gap_start long, gap_end long, gap_reason string"


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """files (file) → a row for each record, and one for each gap that was quarantined (gap_start and so on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        kinds = [types[x.split()[1]] for x in READ_SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for file in b.column(0).to_pylist():
                fs, local = filesystem(file)
                rows, load = [], 0
                with fs.open_input_stream(local, compression=None) as stream:
                    for what, x in salvage(stream):
                        if what == "gap":
                            rows.append((file, *[None] * 9, *x))
                        else:
                            body = x["block"]
                            rid, told = x.get("warc-record-id"), (x.get("warc-payload-digest") or "").removeprefix("sha256:")
                            rows.append((file, rid, page_of(rid), x.get("warc-target-uri"), x.get("warc-type"), page_of(x.get("warc-refers-to")), told, int(x.get("x-payload-length", len(body))), body if payload else None, "resynced" in x, None, None, None))
                            load += len(body) if payload else 100
                        if load > 1 << 23 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, load = [], 0
                if rows:
                    yield batch(rows)

    return each_file(files.select("file")).mapInArrow(run, READ_SCHEMA)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    files = write_archives(decide(pages, url_col="url" if "url" in pages.columns else None), new_path(spark, "warc"))
    got = read_archives(files, payload=False)
    return got.where("gap_start is null").select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
