"""WARC archives: a writer, and a reader that salvages what follows damage.

Records are WARC/1.1, each a gzip member of its own (or plain). A page is an HTTP response; of pages with equal
payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest id is the response and the others
are revisit records that name it, without a payload.

The salvage reader takes an archive from front to back and checks every record: the member's CRC and
end, the version line, the header block, the content length, the two line ends after the block, and the
SHA-256 digests of block and payload where stated. After a failed check it searches for the next member
or version line from which a whole record passes, goes on there, and logs the bytes between as a quarantined gap
(file, start, end, reason). It holds a window of the file and one record or member at a time. Of a
damaged member of several records those that pass are kept, and the member is logged as a gap too. A header block may have any
length up to that of a record, so a url is kept whole however long it is.

Archives are written one a task, under a draft name until whole, so a repeated attempt replaces an equal
file. Finding the first of equal payloads is an aggregation over digests that combines before the shuffle,
and only ids and digests meet to find the revisits; payloads then join their ids once.

Defined results: a null payload is an empty one. Payloads below the size are responses, however often
they occur. Rows of equal id and payload: each is written; ``first`` is decided by id, so rows of the
smallest id are all responses. A null id comes last and is written "null". An empty table gives no
archives. Further input columns are not stored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_slices, materialise, move_shared, one_each, open_shared, small_batches

REVISIT_BYTES = 100
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/[01]\.[0-9]+\r\n")
MEMBER = b"\x1f\x8b\x08"
BEGIN, MARK = re.compile(rb"\x1f\x8b\x08|WARC/"), 4  # what a record begins with, and one byte less than the longer mark

#: Bytes the reader fetches at a time, the first step for a header block, and the most that it takes for a record.
FETCH, HEADER_STEP, RECORD_MOST = 1 << 20, 1 << 16, 1 << 31
#: Bytes among which a version line ends, and places over which a digest's copies are dealt.
VERSION_MOST, SALTS = 32, 16
#: Bytes of a gzip member by which its content must have begun: its head has at most 64 KiB of extra fields, and a name.
HEAD_MOST = 1 << 17


# ---- records -----------------------------------------------------------------------------------


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page)}>"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, first: int | None) -> bytes:
    """A response, or a revisit of page ``first``."""
    name = "null" if page_id is None else str(page_id)
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", name), ("Payload-Length", str(n))]
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(str(first))), ("Refers-To-Page-ID", str(first))]
    return record(fields, http_head(n) + payload if first is None else http_head(n))


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


# ---- salvage -----------------------------------------------------------------------------------


class Window:
    """Random access to a file by a moving buffer."""

    def __init__(self, f) -> None:
        self.f, self.size, self.at, self.held = f, f.size(), 0, b""

    def get(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos."""
        n = max(0, min(n, self.size - pos))
        if pos < self.at or pos + n > self.at + len(self.held):
            self.at, self.held = pos, self.f.read_at(min(max(n, FETCH), self.size - pos), pos) if n else b""
        return self.held[pos - self.at : pos - self.at + n]

    def find(self, pos: int) -> int:
        """The next place at or after pos that may begin a member or a version line; the size if none."""
        while pos < self.size:
            if not self.at <= pos < self.at + len(self.held) - MARK:
                self.get(pos, FETCH)
            if m := BEGIN.search(self.held, pos - self.at):
                return self.at + m.start()
            if self.at + len(self.held) >= self.size:
                break
            pos = self.at + len(self.held) - MARK
        return self.size


class Damage(Exception):
    pass


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block after its HTTP head, where it is an HTTP message."""
        if self.fields.get("content-type", "").startswith("application/http"):
            head, mark, rest = self.block.partition(b"\r\n\r\n")
            return rest if mark else b""
        return self.block


def header_fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, mark, value = line.partition(b":")
        if not mark or not name.strip():
            raise Damage("a header line has no colon")
        last = name.strip().lower().decode("utf-8", "replace")
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def check_record(fields: dict[str, str], block: bytes) -> None:
    stated = fields.get("warc-block-digest", "")
    if stated.startswith("sha256:") and stated[7:] != hashlib.sha256(block).hexdigest():
        raise Damage("the block doesn't match its digest")
    if "warc-type" not in fields:
        raise Damage("no record type")
    stated = fields.get("warc-payload-digest", "")
    if stated.startswith("sha256:") and fields["warc-type"] != "revisit" and stated[7:] != hashlib.sha256(Record(0, 0, fields, block).payload).hexdigest():
        raise Damage("the payload doesn't match its digest")


def header_block(get) -> bytes:
    """The version line and the header lines, whatever their length, read in growing steps until the blank line."""
    n = HEADER_STEP
    if not VERSION.match(get(0, VERSION_MOST)):
        raise Damage("no version line")
    head = get(0, n)
    while (end := head.find(b"\r\n\r\n")) < 0:
        header_fields(head[: head.rfind(b"\r\n")])  # what is no header isn't read to the end of the file
        if len(head) < n or n > RECORD_MOST:
            raise Damage("the header block doesn't end")
        n *= 2
        head = get(0, n)
    return head[:end]


def parse(get, start: int) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, length of the record) of plain record bytes; get(offset, n) gives bytes from its start."""
    head = header_block(get)
    end = len(head)
    fields = header_fields(head)
    length = fields.get("content-length", "")
    if not length.isdecimal() or int(length) > RECORD_MOST:
        raise Damage("no usable content length")
    n = int(length)
    rest = get(end + 4, n + 4)
    if len(rest) < n:
        raise Damage("the block is cut short")
    if rest[n:] != b"\r\n\r\n":
        raise Damage("the block isn't followed by two line ends")
    check_record(fields, rest[:n])
    return fields, rest[:n], end + 8 + n


def inflate(w: Window, start: int) -> tuple[bytes, int, str]:
    """(content, end, "") of the gzip member at start, or after damage (what comes before it, start, reason)."""
    z, pos, out, total = zlib.decompressobj(31), start, [], 0
    while not z.eof:
        part, before = w.get(pos, 1 << 16), z.copy()
        if not part:
            return b"".join(out), start, "the member is cut short"
        try:
            got = z.decompress(part)
        except zlib.error as e:
            try:
                for i in range(len(part)):
                    out.append(before.decompress(part[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), start, f"the member can't be read ({e})"
        if pos == start and len(got) >= 5 and not got.startswith(b"WARC/"):
            raise Damage("the member holds no record")
        if not total and not got and pos - start >= HEAD_MOST:
            raise Damage("the member's head doesn't end")
        total += len(got)
        if total > RECORD_MOST:
            raise Damage("the member is too long")
        out.append(got)
        pos += len(part)
    return b"".join(out), pos - len(z.unused_data), ""


def read_at(w: Window, pos: int) -> tuple[list[Record], int, str]:
    """(records, end, "") at pos: one record, or those of one gzip member.

    Of a damaged member, the records that pass and the reason of the damage; the end is then that of the member, or pos
    where its stream is damaged. Before such damage only records with a block digest pass, as the member's CRC can't tell.
    """
    if w.get(pos, 3) != MEMBER:
        fields, block, n = parse(lambda i, k: w.get(pos + i, k), pos)
        return [Record(pos, pos + n, fields, block)], pos + n, ""
    raw, end, reason = inflate(w, pos)
    broken, out, at = bool(reason), [], 0
    while 0 <= at < len(raw):
        try:
            fields, block, n = parse(lambda i, k, at=at: raw[at + i : at + i + k], at)
            if broken and not fields.get("warc-block-digest", "").startswith("sha256:"):
                raise Damage(reason)
        except Damage as e:
            reason = reason or str(e)
            at = raw.find(b"WARC/", at + 1)
            continue
        out.append(Record(pos, end, fields, block))
        at += n
    if not out:
        raise Damage(reason or "the member is empty")
    return out, end, reason


def salvage(f) -> Iterator[Record | tuple[int, int, str]]:
    """Records, and (start, end, reason) for each quarantined gap, in order of the file."""
    w = Window(f)
    pos, gap, reason = 0, None, ""
    while pos < w.size:
        try:
            found, end, damage = read_at(w, pos)
        except Damage as e:
            if gap is None:
                gap, reason = pos, str(e)
            pos = w.find(pos + 1)
            continue
        if gap is not None:
            yield gap, pos, reason
            gap = None
        yield from found
        if damage:  # what didn't pass of the member is a gap, to its end or to what comes next
            gap, reason = pos, damage
        if damage and end > pos:
            yield gap, end, reason
            gap = None
        pos = end if end > pos else w.find(pos + 1)
    if gap is not None:
        yield gap, w.size, reason


# ---- Spark -------------------------------------------------------------------------------------

ARCHIVES = "file string, n_records long, n_bytes long"


def with_firsts(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """id, url, payload, n, digest, first (the id of the response that a page revisits, else null)."""
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    twice = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "first")
    # a third of all pages may have one payload: their ids are dealt over SALTS places, and the first one's goes to each
    twice = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.filter(F.col("n") >= least).select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    keys = salted.join(twice, ["digest", "salt"]).filter(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first").distinct()
    keys = materialise(keys, "revisits")
    return rows.join(keys, F.col("id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left").select("id", "url", "payload", "n", "digest", "first")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, compress: bool = True) -> DataFrame:
    """Write the pages to archives in ``folder`` (a shared one); (file, n_records, n_bytes) of each."""
    spark = pages.sparkSession
    small_batches(spark)
    end = "warc.gz" if compress else "warc"

    def run(batches):
        part, sink, n, size = TaskContext.get().partitionId(), None, 0, 0
        final, draft = f"{folder}/part-{part:08d}.{end}", f"{folder}/_draft/{part:08d}-{uuid.uuid4().hex}"
        for b in batches:
            for s in byte_slices(b, 2):
                for i, url, payload, length, digest, first in zip(*[c.to_pylist() for c in s.columns], strict=True):
                    if sink is None:
                        sink = open_shared(draft, "wb")
                    raw = page_record(i, url, payload, digest, length, first)
                    raw = gzip_member(raw) if compress else raw
                    sink.write(raw)
                    n, size = n + 1, size + len(raw)
        if sink is not None:
            sink.close()
            move_shared(draft, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    rows = with_firsts(pages, id_col, url_col, html_col, revisit_bytes)
    rows.select("id", "url", "payload", "n", "digest", "first").mapInArrow(run, ARCHIVES).write.parquet(f"{folder}/archives")
    return spark.read.schema(ARCHIVES).parquet(f"{folder}/archives")


FOUND = "file string, start long, end long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record (reason null) and for each quarantined gap (only file, start, end and reason).

    ``files`` has a column ``file``; each archive is one task's. For a revisit, payload_bytes and
    payload_digest are those of the payload it stands for, as its header states them.
    """
    small_batches(spark)
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def row(file: str, r: Record | tuple[int, int, str]) -> tuple:
        if isinstance(r, tuple):
            return (file, *r, None, None, None, None, None, None, None)
        f, number = r.fields, lambda k: int(r.fields[k]) if r.fields.get(k, "").lstrip("-").isdecimal() else None
        kind, payload = f["warc-type"], r.payload
        if kind == "revisit":
            size, digest, payload = number("payload-length"), f.get("warc-payload-digest", "").removeprefix("sha256:"), None
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        return (file, r.start, r.end, None, number("page-id"), f.get("warc-target-uri"), kind, size, digest, number("refers-to-page-id"), payload if payloads else None)

    def run(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                held, size = [], 0
                with open_shared(file, "rb") as f:
                    for r in salvage(f):
                        held.append(row(file, r))
                        size += len(held[-1][-1] or b"") + len(held[-1][5] or "") + 200
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return one_each(files.select("file")).mapInArrow(run, FOUND)
