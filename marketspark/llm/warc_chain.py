"""WARC archives: written by Spark's text sink, read back by byte ranges with boundary-chain verification.

Writing is native: a record is one string, and the sink ends each with the two line ends the format asks for. Of
records with equal payloads one is a response, the others revisit it and keep only their HTTP head.

Reading cuts the archives into byte ranges. Every task looks for the format's first line in its range and emits, for
each place, where a record that began there would end: a candidate and its successor. Payloads may hold the same
line, so a place counts only if it is reached from its file's start. Inside a range the successors are followed at
once, to the first place beyond it; between ranges they are followed by pointer jumping, doubling the step each
round. Records are then read along the chain from each range's verified entry.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import shuffles, spread_join, stash
from marketspark.session import scratch_path

VERSION = "WARC/1.1"
MAGIC = f"{VERSION}\r\n".encode()
END = "\r\n\r\n"
#: bytes of an archive that a task scans at a time
RANGE = 16 << 20
#: bytes read at a time while a record's head is taken apart
STEP = 1 << 16
_FIELD = re.compile(rb"[!-9;-~]+:[^\r\n]*\r\n")
_FILES: dict = {}


# ---- writing -----------------------------------------------------------------------------
def base32(sha1_hex: Column) -> Column:
    """The 40 hex digits of a SHA-1 as 32 upper-case base32 letters: five digits are four letters."""
    part = lambda i: F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*(part(i) for i in range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row, refers_to, refers_row) of the records whose payload another one holds: of ``pages`` (row, page_id, html)
    with equal payloads of ``least_bytes`` or more, all but that with the largest page_id (null least), then first row."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    seen = stash(pages.select("row", "page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= least_bytes).select("row", "page_id", "digest"), "payloads")
    best = F.max(F.struct("page_id", (-F.col("row")).alias("first"))).alias("best")
    groups = seen.groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1")
    groups = stash(groups.select("digest", F.col("best.page_id").alias("refers_to"), (-F.col("best.first")).alias("refers_row")), "payload-groups")
    return spread_join(seen.select("row", "digest"), groups, ["digest"]).where("row <> refers_row").select("row", "refers_to", "refers_row")


def record(date: str) -> Column:
    """The record of a row (row, page_id, url, html, refers_to, refers_row), without the line ends behind it."""
    body = F.coalesce("html", F.lit(""))
    again = F.col("refers_row").isNotNull()
    name = lambda i, r: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(i).cast("string"), F.lit("null")), F.lit(":"), F.col(r).cast("string"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    block = F.when(again, head).otherwise(F.concat(head, body))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", name("page_id", "row")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", url),
              ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(body.cast("binary"))))),
              ("WARC-Refers-To", F.when(again, name("refers_to", "refers_row"))), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
              ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields]
    return F.concat(F.lit(MAGIC.decode()), *lines, F.lit("\r\n"), block)


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record for every row of ``pages`` (row, page_id, url, html) into archives under ``path``, one for each task.

    ``row`` is any distinct number, the same at every reading. Null html is an empty payload, a null url gives no
    target field, other columns are not read; repeated rows get a record each.
    """
    p = pages.select("row", F.col("page_id").cast("long").alias("page_id"), "url", "html")
    again = stash(revisits(p, least_bytes), "revisits")
    p.join(again, "row", "left").select(record(date).alias("value")).write.option("lineSep", END).text(path)


# ---- reading -----------------------------------------------------------------------------
class Archive:
    """Bytes of a file by their place, read in steps and held one step at a time."""

    def __init__(self, path: str, length: int):
        from pyarrow import fs
        if path not in _FILES:
            if len(_FILES) >= 16:
                _FILES.pop(next(iter(_FILES))).close()
            local = path.removeprefix("file:")
            system, name = (fs.LocalFileSystem(), "/" + local.lstrip("/")) if local != path or "://" not in path else fs.FileSystem.from_uri(path)
            _FILES[path] = system.open_input_file(name)
        self.file, self.length, self.lo, self.held = _FILES[path], length, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at``; fewer only at the file's end."""
        if not (self.lo <= at and at + n <= self.lo + len(self.held)):
            self.lo = at
            self.held = self.file.read_at(max(min(max(n, STEP), self.length - at), 0), at)
        return self.held[at - self.lo:at - self.lo + n]

    def line(self, at: int) -> bytes:
        """The line that begins at ``at``, its line end included."""
        n = 256
        while (got := self.get(at, n)).find(b"\n") < 0 and len(got) == n:
            n *= 4
        return got[:got.find(b"\n") + 1]

    def fields(self, at: int) -> tuple[dict[str, str], int] | None:
        """The named fields of a record that begins at ``at`` and where its block begins; None if none can begin there."""
        out: dict[str, str] = {}
        if self.get(at, len(MAGIC)) != MAGIC:
            return None
        at += len(MAGIC)
        while (line := self.line(at)) != b"\r\n":
            if not _FIELD.fullmatch(line):
                return None
            k, v = line[:-2].split(b":", 1)
            out.setdefault(k.decode().lower(), v.strip().decode("utf-8", "replace"))
            at += len(line)
        return out, at + 2

    def successor(self, at: int) -> int | None:
        """Where the record after one that begins at ``at`` would begin; None if none can begin there."""
        found = self.fields(at)
        size = found[0].get("content-length", "") if found else ""
        if not (size.isascii() and size.isdigit()):
            return None
        end = found[1] + int(size)
        return end + len(END) if end + len(END) <= self.length and self.get(end, len(END)) == END.encode() else None


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


_LINKS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64())])
_RECORDS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("url", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("payload", pa.binary())])


def links(ranges: DataFrame) -> DataFrame:
    """(path, at, next, leaves) of every candidate in ``ranges`` (path, length, lo, hi): its successor, and the first
    place beyond the range that its chain of candidates comes to (where the chain breaks off: null)."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                f = Archive(r["path"], r["length"])
                data = f.file.read_at(min(r["hi"] + len(MAGIC) - 1, r["length"]) - r["lo"], r["lo"])
                places = [r["lo"] + m.start() for m in re.finditer(re.escape(MAGIC), data)]
                nexts = {at: n for at in places if (n := f.successor(at)) is not None}
                leaves: dict[int, int | None] = {}
                for at in sorted(nexts, reverse=True):  # successors lie behind, so theirs are known
                    leaves[at] = nexts[at] if nexts[at] >= r["hi"] else leaves.get(nexts[at])
                yield _columns([(r["path"], at, nexts[at], leaves[at]) for at in nexts], _LINKS)
    return ranges.mapInArrow(run, "path string, at long, next long, leaves long")


def reachable(jumps: DataFrame, start: DataFrame) -> DataFrame:
    """(path, at) of the places that chains of ``jumps`` (path, at, leaves) from ``start`` (path, at) come to, ends included.

    Round k adds the places 2**k steps behind those known, then doubles the step; it ends when nothing is new. The
    rounds are kept in the shared folder, only counts come to the driver.
    """
    step = stash(jumps.where("leaves IS NOT NULL").select("path", "at", "leaves"), "jumps")
    known = stash(start.select("path", "at").distinct(), "reached")
    n = known.count()
    while True:
        known = stash(known.join(step, ["path", "at"]).select("path", F.col("leaves").alias("at")).union(known).distinct(), "reached")
        if (more := known.count()) == n:
            return known
        n = more
        far = step.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        step = stash(step.join(far, ["path", "leaves"], "left").select("path", "at", F.coalesce("far", "leaves").alias("leaves")), "jumps")


def _walked(payloads: bool):
    """The records along the chain from ``entry`` to the end of its range; digests of responses are computed anew."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                f, at, out, held = Archive(r["path"], r["length"]), r["entry"], [], 0
                while at < r["hi"] and (end := f.successor(at)) is not None:
                    h, lo = f.fields(at)
                    head, _, payload = f.file.read_at(end - len(END) - lo, lo).partition(END.encode())
                    size, digest = len(payload), h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "revisit":
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head).group(1))
                    elif digest != (digest := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"{r['path']}: the payload of the record at {at} does not have the digest of its head")
                    out.append((r["path"], at, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, payload if payloads else None))
                    held += size
                    if held > 4 << 20:
                        yield _columns(out, _RECORDS)
                        out, held = [], 0
                    at = end
                yield _columns(out, _RECORDS)
    return run


def read(spark: SparkSession, path: str, span: int = RANGE, payloads: bool = False) -> DataFrame:
    """(path, at, type, id, url, refers, digest, bytes, payload) of the records of the archives under ``path``.

    Archives are uncompressed and on a file system that pyarrow opens; files of any size are cut into ranges of
    ``span`` bytes. ``bytes`` and ``digest`` are of the whole payload, for revisits too (from their heads). Empty files
    give no rows. Of a damaged file the records before the damage are returned: none behind it can be reached.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n = shuffles(spark)
    ranges = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))))
    ranges = stash(ranges.withColumn("hi", F.least("length", F.col("lo") + span)).repartition(n), "ranges")
    found = stash(links(ranges.repartition(n)), "links")
    start = files.select("path", F.lit(0).cast("long").alias("at"))
    # only places that another range's chain comes to can be entries; the jumps run over these alone
    entered = found.select("path", F.col("leaves").alias("at")).union(start).distinct()
    entries = reachable(found.join(entered, ["path", "at"]), start)
    first = entries.join(files, "path").where("at < length").select("path", "length", F.col("at").alias("entry"), F.least("length", (F.floor(F.col("at") / span) + 1) * span).alias("hi"))
    return first.repartition(n).mapInArrow(_walked(payloads), "path string, at long, type string, id string, url string, refers string, digest string, bytes long, payload binary")


def _page(name: str) -> Column:
    return F.regexp_extract(name, r"<urn:page:(-?[0-9]+):", 1).try_cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 0, span: int = RANGE) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages`` (row, page_id, url, html), read back
    from archives in the shared folder. Nulls, repeats and clashing columns as in :func:`write`; an empty table gives no rows."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    r = read(pages.sparkSession, path, span)
    return r.select(_page("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), _page("refers").alias("refers_to"))


def round_trip_sql(least_bytes: int = 0) -> str:
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letters = f"substr('{digits[10:]}234567', CAST((CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS BIGINT) + 1, 1)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best, row_number() OVER (PARTITION BY x ORDER BY page_id DESC NULLS LAST) AS k FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j: {letters}), '')), '') AS payload_digest,
 CASE WHEN k > 1 AND payload_bytes >= {least_bytes} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k > 1 AND payload_bytes >= {least_bytes} THEN best END AS refers_to FROM g"""
