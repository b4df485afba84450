"""WARC archives: writing pages as records, and a reader that salvages damaged archives.

Writing: one gzip member for each record; a payload that an earlier page has already is a revisit record.
Reading: every record is checked (gzip checksum, version line, length, block digest, payload digest).  After a
failed check the reader looks for the next gzip member that begins a record, or in plain archives the next
version line, goes on from there, and reports the skipped bytes as a gap.  A member may hold many records: inside
one the reader goes on at the next version line, also when the member is damaged or has no end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import prepare, text_of
from flowlens.session import materialize, scratch_path

#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100
#: An archive is closed when it reaches this many bytes.
ARCHIVE_BYTES = 16 << 20
_STEP = 1 << 18
_HEAD_STEP = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile("[0-9]{1,18}")


# Names of digests in records, written in hexadecimal or base 32.
_DIGESTS = {"md5": "md5", "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512"}


class Damaged(Exception):
    pass


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it; what Hadoop calls s3a is S3 with the usual AWS settings."""
    scheme, _, rest = path.partition("://")
    if scheme in ("s3a", "s3n"):
        return fs.S3FileSystem(), rest
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record.  ``first``: the page that has this payload already, if this is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("revisit" if first is not None else "response"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",  # the pages carry no time
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if first is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, compress: bool):
    ending = ".warc.gz" if compress else ".warc"

    def run(batches):
        store, base = _store(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        done: list[tuple[str, int, int]] = []
        held: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            if held:
                # Written aside and moved, so a lost attempt leaves no half archive behind; named by the attempt,
                # so one that is repeated never writes over archives that another one lists.
                name = f"part-{part:06d}-{len(done):04d}-{attempt}{ending}"
                aside = f"{base}/.{name}"
                with store.open_output_stream(aside, compression=None) as out:  # records are compressed one by one
                    out.write(b"".join(held))
                store.move(aside, f"{base}/{name}")
                done.append((f"{folder}/{name}", size, len(held)))
                held, size = [], 0

        for batch in batches:
            for r in batch.to_pylist():
                data = record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], r["first"])
                if compress:
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = squeeze.compress(data) + squeeze.flush()
                held.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["path", "bytes", "records"],
        )

    return run


def write_archives(pages: DataFrame, folder: str | None = None, compress: bool = True) -> DataFrame:
    """Write the pages and return the archives: path, bytes, records.

    Of pages with equal payloads of at least ``LEAST_SHARED`` bytes the one with the smallest page_id is a
    response, the others are revisits of it; null ids count as larger than all others, and payloads that only
    pages without id have are all responses, as are repeated rows of the smallest id.  A null page has the empty
    payload.  Columns besides page_id, url and html are ignored.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_of("html").alias("html"),
        F.sha2(text_of("html").cast("binary"), 256).alias("digest"),
    )
    shared = (
        rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("smallest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "smallest")
    )
    # Only payloads that occur twice; written first, so that the join is planned with its size.
    marked = rows.join(materialize(shared, "payloads"), "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("smallest")), F.col("smallest")).alias("first"),
    )
    written = marked.mapInArrow(_writer(folder, compress), "path string, bytes long, records long")
    return materialize(written, "archives")


def _head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not _LENGTH.fullmatch(fields.get("content-length", "")) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("required header missing")
    return fields, end + 4


def _checked(fields: dict[str, str], block: bytes) -> bytes | None:
    """The payload of a record whose digests hold; None for records without one."""

    def holds(stated: str, data: bytes) -> bool:
        kind, _, value = stated.partition(":")
        name = _DIGESTS.get(kind.strip().lower())
        if name is None:  # none, or one that nobody here can check
            return True
        made, value = hashlib.new(name, data).digest(), value.strip()
        return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")

    if not holds(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest")
    if fields["warc-type"] != "response":
        return None
    _, split, payload = block.partition(b"\r\n\r\n")
    payload = payload if split else block
    if not holds(fields.get("warc-payload-digest", ""), payload):
        raise Damaged("payload digest")
    return payload


class _Source:
    """Random reads over an archive of any store, a window at a time."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.at, self.window = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.window)):
            self.file.seek(at)
            self.window, self.at = self.file.read(min(max(n, 1 << 20), self.size - at)), at
        return self.window[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """Where ``what`` next begins, or the size."""
        while at < self.size:
            part = self.read(at, _STEP)
            k = part.find(what)
            if k >= 0:
                return at + k
            at += max(1, len(part) - len(what) + 1)
        return self.size


def _member(source: _Source, at: int) -> tuple[bytes, int | None, str]:
    """The bytes of a gzip member, where it ends, and what is wrong with it; its checksum is checked.

    Of a member that is wrong the end is not known, and the bytes are those that could be inflated.
    """
    inflate, out, here = zlib.decompressobj(31), [], at
    while not inflate.eof:
        part = source.read(here, _STEP)
        if not part:
            return b"".join(out), None, _CUT_OFF
        try:
            out.append(inflate.decompress(part))
        except zlib.error as e:
            return b"".join(out) + _before_error(source, at, here), None, f"gzip: {str(e)[:60]}"
        here += len(part)
    return b"".join(out), here - len(inflate.unused_data), ""


_CUT_OFF = "member without end"


def _before_error(source: _Source, at: int, here: int) -> bytes:
    """What the part at ``here``, which cannot be inflated whole, gives before its error."""
    inflate, out = zlib.decompressobj(31), []
    for k in range(at, here, _STEP):
        inflate.decompress(source.read(k, _STEP))
    try:
        for byte in source.read(here, _STEP):
            out.append(inflate.decompress(bytes((byte,))))
    except zlib.error:
        pass
    return b"".join(out)


def _begins_record(source: _Source, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(source.read(at, 512), 5) == b"WARC/"
    except zlib.error:
        return False


def _inside(data: bytes, sure: bool) -> list[tuple]:
    """(fields, payload, "") and (None, None, what was skipped) in the order of a member's bytes.

    ``sure``: nothing says that the bytes are not those written; else records without a digest that can be checked are skipped.
    """
    found, k, gap, reason = [], 0, None, ""

    def skipped():
        return None, None, f"{reason}, bytes {gap} to {k} of the member"

    while k < len(data):
        past = None
        try:
            fields, start = _head(data, k)
            stop = start + int(fields["content-length"])
            if data[stop : stop + 4] != b"\r\n\r\n":
                raise Damaged("record length")
            past = stop + 4
            payload = _checked(fields, data[start:stop])
            if not sure and fields.get("warc-block-digest", "").partition(":")[0].strip().lower() not in _DIGESTS:
                raise Damaged("no digest in a damaged member")
        except Damaged as e:
            gap, reason = (k, str(e)) if gap is None else (gap, reason)
            if past is None or past < len(data) and not _VERSION.match(data, past):
                version = _VERSION.search(data, k + 1)
                past = version.start() if version else len(data)
            k = past
            continue
        if gap is not None:
            found.append(skipped())
            gap = None
        found.append((fields, payload, ""))
        k = past
    if gap is not None:
        found.append(skipped())
    return found


def _gz_records(source: _Source, at: int):
    """What a member holds, as of :func:`_inside`, and where the next one begins."""
    data, end, wrong = _member(source, at)
    found = _inside(data, wrong in ("", _CUT_OFF))
    gaps = [x[2] for x in found if x[0] is None]
    # Where the checksum of a single record fails, the damage is in that record.
    if len(gaps) == len(found) and (found or wrong) or len(found) == 1 and wrong not in ("", _CUT_OFF):
        raise Damaged(wrong or gaps[0].partition(",")[0])
    if wrong and not gaps:
        found.append((None, None, wrong))
    elif wrong:
        found = [(f, p, f"{wrong}, {skipped}" if f is None else "") for f, p, skipped in found]
    return found, _next_begin(source, at + 1, True) if end is None else end


def _plain_record(source: _Source, at: int):
    size = _HEAD_STEP
    data = source.read(at, size)
    # Headers have no greatest length; one that has a line without colon is none.
    while b"\r\n\r\n" not in data and len(data) == size and all(b":" in x for x in data.split(b"\r\n")[1:-1]):
        size *= 4
        data = source.read(at, size)
    fields, start = _head(data, 0)
    length = int(fields["content-length"])
    if at + start + length + 4 > source.size:
        raise Damaged("record length")
    data = source.read(at + start, length + 4)
    if data[length:] != b"\r\n\r\n":
        raise Damaged("record length")
    return [(fields, _checked(fields, data[:length]), "")], at + start + length + 4


def _next_begin(source: _Source, at: int, compressed: bool) -> int:
    """Where a record may begin, or the size."""
    while at < source.size:
        at = source.find(_MAGIC if compressed else b"WARC/1.", at)
        if at >= source.size or not compressed or _begins_record(source, at):
            break
        at += 1
    return at


def read_records(source: _Source, compressed: bool) -> Iterator[tuple]:
    """("record", start, end, fields, payload) and ("gap", start, end, reason, None), in the order of the bytes.

    A gap inside a gzip member has the start and end of the member, as its records have, and names the skipped
    part of the inflated bytes in its reason.
    """
    at, gap, reason = 0, None, ""
    while at < source.size:
        try:
            found, end = _gz_records(source, at) if compressed else _plain_record(source, at)
        except Damaged as e:
            gap, reason = (at, str(e)) if gap is None else (gap, reason)
            at = _next_begin(source, at + 1, compressed)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        for fields, payload, skipped in found:
            if fields is None:
                yield "gap", at, end, skipped, None
            else:
                yield "record", at, end, fields, payload
        at = end
    if gap is not None:
        yield "gap", gap, source.size, reason, None


READ = (
    "kind string, path string, start long, end long, reason string, record_type string, record_id string,"
    " target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
)


def _reader(batches):
    names = [x.split()[0] for x in READ.replace(", ", ",").split(",")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = _store(path)
            rows, size = [], 0
            with store.open_input_file(inner) as file:
                for kind, start, end, fields, payload in read_records(_Source(file, file.size()), path.endswith(".gz")):
                    if kind == "gap":
                        rows.append((kind, path, start, end, fields, *[None] * 7))
                    else:
                        length = fields.get("x-payload-length", "")
                        rows.append((
                            kind, path, start, end, None, fields["warc-type"], fields["warc-record-id"],
                            fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                            fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
                            int(length) if length.isdigit() else None, payload,
                        ))
                        size += len(payload or b"")
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records and gaps of the archives in column ``path``; rows of kind ``record`` or ``gap``.

    Gaps name the first and the end byte that were skipped and the check that failed; one inside a gzip member has
    the member's first and end byte, and the skipped part in its reason.  Records before and after a gap are whole.
    Where a member of several records fails its checksum, those whose block digest holds are given out.  A record without payload (revisit) has null there.  An empty archive gives no rows.
    """
    spark = prepare(archives.sparkSession)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    return archives.select("path").repartition(tasks).mapInArrow(_reader, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = read_archives(write_archives(pages)).where("kind = 'record'")

    def page(column):
        return F.expr(f"try_cast(nullif(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)")

    response = F.col("record_type") == "response"
    return read.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
