"""WARC archives of web pages: writing with revisit records, and verified reading.

*Writing.*  Payloads are grouped by SHA-1 digest and length.  Of a group of
at least ``revisit_bytes`` bytes the row with the largest page_id is a
``response``, the others are ``revisit`` records that name it.  A record ID is
a tag URI of page_id and digest, so standard headers carry all that is read
back.  Records are built as strings and written by Spark's text writer with
the record terminator as line separator, so archives can go to any store Spark
writes to.  Pages are dealt to files by row key, and each file is one gzip member:
at most about ``file_bytes`` of records, or less where that gives every task a
file.

*Reading.*  Archives, plain or gzip of any members, are read as text lines, so
a task streams a byte range of a plain archive or a whole gzip one, and holds
no more than the lines at hand.  Offsets count in the plain bytes: those in a
range start from the sum of the ranges before it.

1. Each task lists every line that starts like a record as a candidate, with
   the offset of its successor from the candidate's Content-Length.  A header
   or block that goes on past the range is completed from the next ranges.
2. Pointer jumping, in two levels.  A task doubles the pointers inside its
   range until each candidate points to where its chain leaves the range.
   Across ranges, the candidate at offset 0 of each file is marked, and each
   round marks what the marked point to and doubles all pointers, as joins over
   all files, until no chain has links left.  Ranges then mark their
   own part of the chain.  A record's start inside a payload is never on it.
3. Payloads of marked candidates are digested.  Those that lie in one range are
   digested as they stream by; of those that cross ranges the pieces are
   read again, for at most ``at_once`` ranges at a time, and joined.

A chain that breaks off before the end of its file, or a payload that does not
match its digest, is an error unless ``strict`` is false; then the records
before the break are returned.

Defined results: a null html is an empty payload; a null url has no
WARC-Target-URI; control characters and spaces in a url are written as %20;
a null page_id is kept, and rows with null ids revisit the largest id; rows
that repeat, or tie for the largest id, are each a response.  The length of a
revisited payload is that of the response it names, null if no archive read
has it.  A very long payload is streamed, but it must fit in one row where it
crosses ranges or is returned.  Extra columns are not read.  An empty table
gives an empty archive folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import checkpoint_dir, checkpointed, partitions, row_key

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Record IDs of pages are <TAG page_id / digest>.
TAG = "tag:pages.invalid,2000:page/"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: 8 groups of 20 bits, 4 letters each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit(f"<{TAG}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit("/"), digest, F.lit(">"))


def _page_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, f"^<{re.escape(TAG)}(-?[0-9]+)/", 1), F.lit("")).cast("long")


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 0, file_bytes: int = 1 << 30, date: str = DATE) -> None:
    """Archives of ``pages(page_id, url, html)`` under ``path``."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("rid", row_key("page_id", "url", "html"))
    ids = rows.select("rid", "page_id", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    last = ids.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"))
    revisit = (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    about = ids.join(last, ["digest", "bytes"]).select("rid", "digest", "bytes", F.when(revisit, F.col("last")).alias("refers"), revisit.alias("revisit")).distinct()

    total = rows.agg(F.sum(F.octet_length("html") + 600)).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes), min(partitions(spark), -(-int(total) // (16 << 20))))
    full = rows.repartition(files, "rid").join(about, "rid")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    block = F.concat(F.lit(HTTP), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers"), F.col("digest"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    full.select(record.alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_START = re.compile(rb"^WARC/1\.[01]\r\n", re.MULTILINE)
_HEAD_LINE = re.compile(rb"[^\x00-\x20:][^:\r\n]*:[^\r\n]*\r\n|[ \t][^\r\n]*\r\n")


def _head_end(data: bytes, at: int) -> int:
    """Where the header lines from ``at`` on end, blank line included; -1 if they are none, -2 if ``data`` ends first."""
    while True:
        stop = data.find(b"\n", at) + 1
        if not stop:
            return -2
        if stop - at == 2 and data[at] == 13:
            return stop
        if not _HEAD_LINE.fullmatch(data, at, stop):
            return -1
        at = stop


class Candidate:
    """A record's start, and as much of the record as has been read."""

    def __init__(self, at: int, head: bytes, block: int, keep: bool):
        self.at, self.block, self.pos = at, block, block
        fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(head)}
        text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
        length = fields.get(b"content-length", b"")
        self.end = block + int(length) if length.isdigit() else -1
        self.kind, self.record_id, self.refers, self.uri = text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), text(b"warc-target-uri")
        said = text(b"warc-payload-digest")
        self.said = said.removeprefix("sha1:") if said is not None else None
        self.is_http = self.http = b"application/http" in fields.get(b"content-type", b"")
        self.before = self.after = b""
        self.sha, self.size, self.kept = hashlib.sha1(), 0, [] if keep else None

    def read(self, data: bytes, base: int) -> None:
        """Take what ``data``, which starts at offset ``base``, has of the block and of the terminator after it."""
        a, b = self.pos - base, min(self.end - base, len(data))
        if a < b:
            self._payload(data[a:b])
            self.pos = base + b
        if self.pos >= self.end:
            more = data[max(self.pos - base, 0) : max(self.end + 4 - base, 0)]
            self.after += more
            self.pos += len(more)

    def _payload(self, part: bytes) -> None:
        if self.http:  # what comes before the blank line is the answer's own header
            part = self.before + part
            stop = part.find(END)
            if stop < 0:
                self.before = part
                return
            part, self.http, self.before = part[stop + 4 :], False, b""
        self.sha.update(part)
        self.size += len(part)
        if self.kept is not None:
            self.kept.append(part)

    @property
    def read_whole(self) -> bool:
        return self.pos >= self.end + 4

    def row(self, whole: bool) -> tuple:
        to = -1 if self.end < 0 or (whole and self.after != END) else self.end + 4
        digest = base64.b32encode(self.sha.digest()).decode() if whole else None
        return self.at, to, self.block, self.kind, self.record_id, self.refers, self.uri, self.said, self.is_http, digest, self.size if whole else None, b"".join(self.kept) if self.kept is not None and whole else None


class Range:
    """The lines of one byte range, streamed; offsets count from its first line."""

    def __init__(self, keep: bool):
        self.keep, self.base, self.rest, self.size = keep, 0, b"", 0
        self.open: list[Candidate] = []
        self.lead, self.leading = b"", True
        self.links: list[tuple[int, int]] = []

    def add(self, data: bytes) -> list[tuple]:
        """The candidates that ``data``, whole lines, completes."""
        if self.leading:
            self._lead(data)
        data, self.size = self.rest + data, self.size + len(data)
        done, stop = [], len(data)
        for m in _START.finditer(data):
            end = _head_end(data, m.end())
            if end == -2:
                stop = m.start()
                break
            if end > 0:
                c = Candidate(self.base + m.start(), data[m.end() : end], self.base + end, self.keep)
                if c.end >= 0:
                    self.open.append(c)
        for c in self.open:
            c.read(data, self.base)
        done += [c.row(True) for c in self.open if c.read_whole and c.after == END]
        self.links += [row[:2] for row in done]
        self.open = [c for c in self.open if not c.read_whole]
        self.base, self.rest = self.base + stop, data[stop:]
        return done

    def _lead(self, data: bytes) -> None:
        """Header lines that the range starts with: they may complete a header that began before."""
        data = self.lead + data
        end = _head_end(data, 0)
        if end == -2:
            self.lead = data
            return
        at = 0
        while end == -1 and (stop := data.find(b"\n", at) + 1) and _HEAD_LINE.fullmatch(data, at, stop):
            at = stop
        self.lead, self.leading = data[: end if end > 0 else at], False


_CANDIDATE = [("at", pa.int64()), ("to", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("uri", pa.string()), ("said", pa.string()), ("http", pa.bool_()), ("digest", pa.string()), ("size", pa.int64()), ("payload", pa.binary())]
_SCHEMA = pa.schema([("path", pa.string()), ("start", pa.int64()), *_CANDIDATE, ("bytes", pa.int64()), ("length", pa.int64()), ("lead", pa.binary()), ("rest", pa.binary()), ("links", pa.binary()), ("exits", pa.binary())])
_DDL = "path string, start long, at long, to long, block long, kind string, record_id string, refers string, uri string, said string, http boolean, digest string, size long, payload binary, bytes long, length long, lead binary, rest binary, links binary, exits binary"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, start, length, whole lines) of the rows (line, path, start, length), which come range by range."""
    for batch in batches:
        n, path, start = batch.num_rows, batch.column(1), batch.column(2)
        a = 0
        while a < n:
            p, s = path[a].as_py(), start[a].as_py()
            b = n
            if path[n - 1].as_py() != p or start[n - 1].as_py() != s:
                b = next(k for k in range(a, n) if start[k].as_py() != s or path[k].as_py() != p)
            yield p, s, batch.column(3)[a].as_py(), b"\n".join(batch.column(0).slice(a, b - a).to_pylist()) + b"\n"
            a = b


def exits(links: np.ndarray) -> np.ndarray:
    """Where the chain from each of the ascending ``links(at, to)`` leaves them, by pointer jumping."""
    at, far = links[:, 0], links[:, 1].copy()
    while len(at):
        where = np.minimum(np.searchsorted(at, far), len(at) - 1)
        inside = at[where] == far
        if not inside.any():
            break
        far[inside] = far[where[inside]]
    return far


def chain(links: np.ndarray, start: int) -> np.ndarray:
    """The ``at`` of all links that the chain from ``start`` passes."""
    at, n = links[:, 0], len(links)
    jump = np.append(np.where(np.isin(links[:, 1], at), np.searchsorted(at, links[:, 1]), n), n)
    mark = np.zeros(n + 1, dtype=bool)
    mark[:n] = at == start
    while not (jump == n).all():
        mark[jump[mark]] = True
        mark[n], jump = False, jump[jump]
    return at[mark[:n]]


def _scan(keep: bool):
    """Candidates of each range, and one row with its bytes, its lead and the header that it breaks off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, length = None, None, -1
        none = (None,) * len(_CANDIDATE)

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

        def close():
            rows = [(*now, *c.row(False), *(None,) * 6) for c in part.open]
            links = np.array(sorted(part.links + [c.row(False)[:2] for c in part.open]), dtype=np.int64).reshape(-1, 2)
            ends = np.unique(exits(links))
            return told([*rows, (*now, *none, part.size, length, part.lead, part.rest or None, links.tobytes(), ends.tobytes())])

        for p, s, n, data in _ranges(batches):
            if (p, s) != now:
                if now is not None:
                    yield close()
                now, part, length = (p, s), Range(keep), n
            done = part.add(data)
            if done:
                yield told([(p, s, *c, *(None,) * 6) for c in done])
        if now is not None:
            yield close()

    return run


_RANGE = "path string, start long, base long, bytes long, links binary, entries binary, at long, to long, block long, kind string, record_id string, refers string, uri string, said string, http boolean"


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole files in order → where each begins and which chains enter it, and the candidates whose header crosses ranges."""
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("base", pa.int64()), ("bytes", pa.int64()), ("links", pa.binary()), ("entries", pa.binary()), *_CANDIDATE[:9]])
    path, base, pending, at, targets = None, 0, b"", 0, {0}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["path"] != path:
                path, base, pending, targets = r["path"], 0, b"", {0}
            if pending:
                pending += r["lead"] or b""
                end = _head_end(pending, pending.find(b"\n") + 1)
                if end > 0:
                    c = Candidate(at, pending[pending.find(b"\n") + 1 : end], at + end, False)
                    if c.end >= 0:
                        rows.append((path, r["start"], base, None, None, None, *c.row(False)[:9]))
                        targets.add(c.end + 4)
                if end != -2:
                    pending = b""
            stop = base + r["bytes"]
            enter = sorted(t for t in targets if base <= t < stop)
            targets = {t for t in targets if t >= stop} | {t for t in (np.frombuffer(r["exits"], dtype=np.int64) + base).tolist() if t >= stop}
            rows.append((path, r["start"], base, r["bytes"], r["links"], np.array(enter, dtype=np.int64).tobytes(), *(None,) * 9))
            if r["rest"]:
                at, pending = stop - len(r["rest"]), r["rest"]
            base = stop
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, at, to): candidates at which a chain may enter a range, with where it leaves."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            links = np.frombuffer(r["links"], dtype=np.int64).reshape(-1, 2) + r["base"]
            enter = np.frombuffer(r["entries"], dtype=np.int64)
            known = np.isin(links[:, 0], enter)
            rows += [(r["path"], r["start"], a, b) for a, b in zip(links[known, 0].tolist(), exits(links)[known].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "start", "at", "to"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at): the part of the chain that lies in each range that it enters at ``entry``."""
    for batch in batches:
        for r in batch.to_pylist():
            got = chain(np.frombuffer(r["links"], dtype=np.int64).reshape(-1, 2) + r["base"], r["entry"])
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(got), pa.string()), pa.array(got, pa.int64())], ["path", "at"])


def reachable(links: DataFrame) -> DataFrame:
    """(path, at) of the candidates of ``links(path, at, to)`` that the chain from offset 0 of their file reaches.

    Each round marks what the marked point to and replaces every pointer by
    its target's, so the rounds grow with the logarithm of a file's records.
    """
    few = max(1, -(-links.count() // 200_000))  # files of a written round
    state = checkpointed(links.select("path", "at", F.when(F.col("to") >= 0, F.col("to")).alias("next"), (F.col("at") == 0).alias("mark")).coalesce(few))
    most = state.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):  # a chain has no more links than its file has candidates
        pushed = state.where("mark and next is not null").select("path", F.col("next").alias("at"), F.lit(True).alias("hit")).distinct()
        after = state.select("path", F.col("at").alias("next"), F.col("next").alias("skip"))
        jumped = state.join(after, ["path", "next"], "left").select("path", "at", F.col("skip").alias("next"), "mark")
        state = checkpointed(jumped.join(pushed, ["path", "at"], "left").select("path", "at", "next", (F.col("mark") | F.col("hit").isNotNull()).alias("mark")).coalesce(few))
    return state.where("mark").select("path", "at")


def _pieces(wanted: dict[tuple[str, int], tuple[int, list[tuple[int, int, int]]]]):
    """(path, at, offset, piece) of the blocks and terminators (at, begin, end) that lie in each range."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("offset", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, 0
        for p, s, _, data in _ranges(batches):
            if (p, s) != now:
                now, (base, blocks) = (p, s), wanted.get((p, s), (0, []))
            rows = [(p, at, max(a, base), data[max(a - base, 0) : b - base]) for at, a, b in blocks if a < base + len(data) and b > base]
            base += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _joined(keep: bool):
    """Digests of the blocks whose pieces come in order, each with its candidate's end."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("whole", pa.bool_()), ("digest", pa.string()), ("size", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                head = b"Content-Type: application/http\r\n" if r["http"] else b""
                c = Candidate(r["at"], head + b"Content-Length: %d\r\n" % (r["to"] - 4 - r["block"]), r["block"], keep)
                for x in sorted(r["pieces"], key=lambda x: x["offset"]):
                    c.read(x["piece"], x["offset"])
                _, to, *_, digest, size, payload = c.row(True)
                rows.append((r["path"], r["at"], c.read_whole and to >= 0, digest, size, payload))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


_PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst)$")


def _lines(spark: SparkSession, path) -> DataFrame:
    packed = F.col("_metadata.file_path").rlike(_PACKED.pattern)
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.when(packed, F.lit(-1)).otherwise(F.col("_metadata.file_size")).cast("long").alias("length")]
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), *meta)


def _crossing(spark: SparkSession, blocks: DataFrame, payloads: bool, at_once: int) -> DataFrame:
    """Digests of marked ``blocks(path, at, block, to, http)`` that lie in several ranges."""
    files = [r["path"] for r in blocks.select("path").distinct().collect()]  # plain archives of several ranges
    pieces = None
    by_path = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(0, len(files), at_once):
        lines = _lines(spark, files[k : k + at_once])
        sizes = lines.groupBy("path", "start").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
        sizes = checkpointed(sizes.withColumn("base", F.coalesce(F.sum("bytes").over(by_path), F.lit(0))))
        hit = sizes.join(blocks, "path").where((F.col("base") < F.col("to")) & (F.col("base") + F.col("bytes") > F.col("block")))
        hit = checkpointed(hit.select("path", "start", "base", "at", "block", "to"))
        parts = -(-hit.count() // at_once)
        for p in range(parts):
            wanted: dict[tuple[str, int], tuple[int, list]] = {}
            for r in hit.where(F.pmod(F.xxhash64("path", "start"), F.lit(parts)) == p).collect():  # about at_once rows
                wanted.setdefault((r["path"], r["start"]), (r["base"], []))[1].append((r["at"], r["block"], r["to"]))
            got = checkpointed(lines.mapInArrow(_pieces(wanted), "path string, at long, offset long, piece binary"))
            pieces = got if pieces is None else pieces.union(got)
    if pieces is None:
        return spark.createDataFrame([], "path string, at long, whole boolean, digest string, size long, payload binary")
    whole = pieces.groupBy("path", "at").agg(F.collect_list(F.struct("offset", "piece")).alias("pieces")).join(blocks, ["path", "at"])
    return whole.mapInArrow(_joined(payloads), "path string, at long, whole boolean, digest string, size long, payload binary")


def read_warc(spark: SparkSession, path: str, strict: bool = True, payloads: bool = False, at_once: int = 100_000) -> DataFrame:
    """The records of all archives under ``path``, with payloads if asked for."""
    scanned = checkpointed(_lines(spark, path).mapInArrow(_scan(payloads), _DDL))
    ranges = scanned.where("bytes is not null").select("path", "start", "bytes", "lead", "rest", "links", "exits")
    ranges = checkpointed(ranges.repartition("path").sortWithinPartitions("path", "start").mapInArrow(_stitch, _RANGE))
    bases = ranges.where("bytes is not null").select("path", "start", "base")
    crossed = ranges.where("at is not null").select("path", "at", "to", "block", "kind", "record_id", "refers", "uri", "said", "http")
    inside = scanned.where("at is not null").join(bases, ["path", "start"])
    moved = [(F.col(c) + F.col("base")).alias(c) for c in ("at", "block")] + [F.when(F.col("to") >= 0, F.col("to") + F.col("base")).otherwise(F.col("to")).alias("to")]
    found = inside.select("path", *moved, "kind", "record_id", "refers", "uri", "said", "http", "digest", "size", "payload")
    found = found.unionByName(crossed, allowMissingColumns=True)
    whole = ranges.where("bytes is not null").select("path", "start", "base", "links", "entries")
    enter = checkpointed(whole.mapInArrow(_entered, "path string, start long, at long, to long").union(crossed.select("path", F.lit(-1).cast("long"), "at", "to")))
    entry = checkpointed(reachable(enter.select("path", "at", "to")).join(enter, ["path", "at"]).select("path", "start", F.col("at").alias("entry")))
    walked = whole.join(entry, ["path", "start"]).select("path", "base", "links", "entry").mapInArrow(_walked, "path string, at long")
    walked = walked.union(entry.where("start = -1").select("path", "entry"))
    marked = checkpointed(found.join(walked, ["path", "at"]))

    open_ = marked.where("digest is null").select("path", "at", "block", "to", "http")
    late = _crossing(spark, open_, payloads, at_once)
    both = marked.join(late.select("path", "at", "whole", F.col("digest").alias("d"), F.col("size").alias("s"), F.col("payload").alias("p")), ["path", "at"], "left")
    records = both.withColumns({"digest": F.coalesce("digest", "d"), "size": F.coalesce("size", "s"), "payload": F.coalesce("payload", "p"), "ends": F.col("digest").isNotNull() | F.coalesce("whole", F.lit(False))})
    # a last line without its end counts one byte too many
    total = scanned.where("bytes is not null").groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("length").alias("length"))
    total = total.select("path", F.when(F.col("length") >= 0, F.col("length")).otherwise(F.col("bytes")).alias("bytes"))
    records = checkpointed(records.drop("d", "s", "p", "whole").join(total, "path").where("ends and to <= bytes").drop("ends", "bytes"))
    if strict:
        _verify(total, records)
    lengths = records.where("kind = 'response' and record_id is not null").groupBy(F.col("record_id").alias("refers")).agg(F.max("size").alias("length"))
    records = records.join(lengths, "refers", "left")
    again = F.col("kind") == "revisit"
    out = [
        _page_of(F.col("record_id")).alias("page_id"), "uri", F.col("kind").alias("record_type"), F.when(again, F.col("said")).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(again, F.col("length")).otherwise(F.col("size")).alias("payload_bytes"), _page_of(F.col("refers")).alias("refers_to"), F.col("path").alias("archive"), F.col("at").alias("offset"),
        "record_id", F.col("refers").alias("refers_to_record"),
    ]
    return records.select(*out, *(["payload"] if payloads else []))


def _verify(total: DataFrame, records: DataFrame) -> None:
    """An error unless every file's chain ends where the file does and every digest holds."""
    last = records.groupBy("path").agg(F.max("to").alias("to"))
    broken = total.join(last, "path", "left").where(F.coalesce("to", F.lit(-1)) != F.col("bytes")).select("path").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['path']}: the chain of records breaks off")
    wrong = records.where("kind <> 'revisit' and said is not null and said <> digest").select("path", "at").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['path']}: payload at {wrong[0]['at']} does not match its digest")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """``pages`` written to the shared folder and read back."""
    path = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
