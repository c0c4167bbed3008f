"""WARC archives: writing with revisit records, and a splittable reader.

Every record is a gzip member of its own.  The reader needs no index: a task
gets a byte range, looks for the gzip magic in it, validates a candidate by
decoding its first bytes as a WARC header, and owns the records that start in
its range, reading on past its end for the last one.  A range may begin inside a
record whose payload holds members of its own: the first candidate and
CHAIN more that follow it must each end where another member or the file's end
is.  What this can't tell: a payload with more members in a row than
that, and a genuine candidate with a damaged member right after it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.llm.shared import durable, new_folder, shuffle_width

SPLIT = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
#: Members that must follow the first candidate of a range without a gap.
CHAIN = 4
#: Packed bytes that are decoded at once.
_FEED = 16 << 10
#: A header that has not ended after so many bytes is none.
_MOST_HEADER = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, which tells the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), and keep: the largest page_id with the same payload (its own for payloads under least_bytes).

    Only page_id and the digest are grouped; the join brings one row for each
    digest that several pages have, so that Spark can split such a digest's pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    several = keyed.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    last = F.when(F.octet_length("html") >= least_bytes, F.col("keep"))
    return keyed.join(several.select("digest", "keep"), "digest", "left").select("page_id", "url", "html", F.coalesce(last, "page_id").alias("keep"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one archive for each task that has pages into folder (any URI that Arrow can open); returns path, records and size of each.

    A task writes under a name of its own and moves the whole file to its final
    name, so that a task that is run again replaces an equal file.  The list is
    kept in the shared folder: reading it does not write again.
    """

    def write(batches):
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, records, size, out = f"{base}/.{uuid.uuid4().hex}", 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                member = _member(row["page_id"], row["url"], payload, digest_of(payload), None if row["keep"] == row["page_id"] else row["keep"])
                out = out or where.open_output_stream(own, compression=None)
                out.write(member)
                records, size = records + 1, size + len(member)
        if out is not None:
            out.close()
            where.move(own, name)
            yield pa.RecordBatch.from_pylist([{"path": name, "records": records, "size": size}])

    return durable(with_revisits(pages, least_bytes).mapInArrow(write, "path string, records long, size long"))


class _Source:
    """Bytes of a file from anywhere on, read piece by piece; held begins at the place at."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.at, self.held, self.used, self.ended = file, at, bytearray(), 0, False
        file.seek(at)

    def part(self, begin: int, size: int) -> bytes:
        """Up to size bytes from begin on, counted from at; fewer only at the file's end."""
        while not self.ended and len(self.held) - self.used < begin + size:
            got = self.file.read(_READ)
            self.held += got
            self.ended = not got
        return bytes(self.held[self.used + begin : self.used + begin + size])

    def skip(self, n: int) -> None:
        self.used, self.at = self.used + n, self.at + n
        if self.used > 2 * _READ:
            del self.held[: self.used]
            self.used = 0


def _inflate(source: _Source, begin: int = 0, most: int | None = None, keep: bool = True) -> tuple[bytes, int] | None:
    """The gzip member begin bytes on and its packed length; most: its first so many bytes, read on as far as they need. None: no such member."""
    engine, out, used, size = zlib.decompressobj(31), [], 0, 0
    while True:
        part = source.part(begin + used, _FEED)
        if not part:
            return None
        try:
            got = engine.decompress(part, 0 if most is None else most - size)
        except zlib.error:
            return None
        if keep:
            out.append(got)
        used += len(part) - len(engine.unused_data) - len(engine.unconsumed_tail)
        size += len(got)
        if engine.eof or (most is not None and size >= most):
            return b"".join(out), used


def _begins(source: _Source, begin: int = 0) -> bool:
    """Whether a member that decodes as a WARC record begins so many bytes on."""
    if source.part(begin, len(_MAGIC)) != _MAGIC:
        return False
    first = _inflate(source, begin, 64)
    return first is not None and first[0].startswith(b"WARC/")


def _goes_on(source: _Source) -> bool:
    """Whether members follow each other from here on: CHAIN more of them, or up to the file's end."""
    begin = 0
    for _ in range(1 + CHAIN):
        whole = _inflate(source, begin, keep=False)
        if whole is None:
            return False
        begin += whole[1]
        if not source.part(begin, 1):
            return True
        if not _begins(source, begin):
            return False
    return True


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").splitlines()[1:])}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def _record(raw: bytes) -> dict:
    """A record of any type. The payload is what follows the HTTP head of an HTTP message, and the block of anything else."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = _fields(head)
    kind, size = named.get("warc-type", ""), _number(named.get("content-length"))
    block = rest if size is None else rest[:size]
    http, mark, payload = block.partition(b"\r\n\r\n")
    message = named.get("content-type", "").startswith("application/http") and mark
    if not message:
        http, payload = b"", block
    digest = named.get("warc-payload-digest", "")
    told = digest.removeprefix("sha1:") if digest.startswith("sha1:") else None
    if kind == "revisit":
        found, length, payload = told, _number(_fields(http).get("content-length")), None
    else:
        found, length = digest_of(payload), len(payload)
        if (told is not None and message and told != found) or (size is not None and len(block) != size):
            raise ValueError(f"record {named.get('warc-record-id')} is damaged")
    page = lambda x: _number(x.strip("<>").removeprefix(_URN)) if x and x.startswith(f"<{_URN}") else None
    return {"page_id": page(named.get("warc-record-id")), "url": named.get("warc-target-uri"), "payload_bytes": length, "payload_digest": found, "record_type": kind, "refers_to": page(named.get("warc-refers-to")), "record_id": named.get("warc-record-id"), "payload": payload}


def records_in(file: pa.NativeFile, start: int, length: int) -> Iterator[dict]:
    """The records that start in the byte range."""
    source, sure = _Source(file, start), start == 0
    while source.at < start + length:
        head = source.part(0, len(_MAGIC))
        if len(head) < len(_MAGIC):
            return
        if head != _MAGIC:
            held = source.part(0, _FEED)
            spot = held.find(_MAGIC)  # it may lie across the end of what is held
            source.skip(spot if spot > 0 else len(held) - len(_MAGIC) + 1)
            sure = False
            continue
        if not _begins(source) or not (sure or _goes_on(source)):
            source.skip(1)
            continue
        whole = _inflate(source)
        if whole is None or whole[0].find(b"\r\n\r\n", 0, _MOST_HEADER) < 0:
            source.skip(1)
            sure = False
            continue
        sure = True
        yield _record(whole[0])
        source.skip(whole[1])


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, split: int = SPLIT, keep_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, record_id and payload (null for revisits) of every record.

    Any WARC record is read, such as warcinfo or request; page_id and refers_to
    are null where an id is not one that write_archives() gives.

    archives: path and size of each file, as write_archives() gives them.  A
    file is cut into ranges of split bytes whatever its records' sizes are.
    """
    columns = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())] + [("payload", pa.binary())] * keep_payload
    schema = pa.schema(columns)

    def read(batches):
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                with where.open_input_file(row["path"]) as file:
                    for record in records_in(file, row["start"], split):
                        if not keep_payload:
                            del record["payload"]
                        held.append(record)
                        size += len(record["payload"] or b"") if keep_payload else 100
                        if size > _READ:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    ranges = archives.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    dealt = ranges.repartition(shuffle_width(spark), "path", "start")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string" + ", payload binary" * keep_payload)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, keep_payload: bool = False) -> DataFrame:
    """The records of pages (page_id, url, html) as read back from archives in the shared folder.

    A null html is an empty payload.  Rows with equal payloads of least_bytes at
    least revisit the one with the largest page_id; rows that repeat this
    page_id are all responses.  A row without a page_id has a record without a
    number; it revisits a page that has one, and is a response where none has.
    No pages give no archives and no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, least_bytes), folder, keep_payload=keep_payload)
