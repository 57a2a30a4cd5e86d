"""WARC in ZIP packages: writing, and reading by ranges without extraction."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm.common import shared_folder, stage

#: Bytes of records after which a task goes on in another package, and bytes of records that one read fetches.
PACKAGE_BYTES = 1 << 30
RANGE_BYTES = 8 << 20

#: Fixed values of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
NONE16, NONE32 = 0xFFFF, 0xFFFFFFFF

DATA_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.jsonl"


# ---- ZIP directories ---------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  # as stored
    full_size: int
    header: int  # offset of its local header

    @property
    def stored(self) -> bool:
        return self.method == 0


def _read(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    got = f.read(size)
    if len(got) != size:
        raise ValueError(f"package ends at {offset + len(got)}, {size} bytes are due at {offset}")
    return got


def directory(f, size: int) -> list[Member]:
    """The members of a package of ``size`` bytes, from its central directory (ZIP64 too)."""
    tail_at = max(0, size - 22 - NONE16 - 20)
    tail = _read(f, tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0:  # a comment may hold the same four bytes
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if NONE16 == count or NONE32 in (length, offset):
        at = end - 20
        if at < 0 or tail[at : at + 4] != LOCATOR64:
            raise ValueError("no ZIP64 locator before the end of central directory")
        record = _read(f, struct.unpack_from("<Q", tail, at + 8)[0], 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator does not point at a ZIP64 record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    raw = _read(f, offset, length)
    out, at = [], 0
    for _ in range(count):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values, only of the fields that say so, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(values) if full == NONE32 else full
                stored = next(values) if stored == NONE32 else stored
                header = next(values) if header == NONE32 else header
            k += 4 + n
        out.append(Member(name, method, stored, full, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(f, member: Member) -> int:
    """Where a member's bytes begin: after its local header, whose lengths may differ from the directory's."""
    raw = _read(f, member.header, 30)
    if raw[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", raw, 26))


# ---- records -----------------------------------------------------------------------


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit without (payload None)."""
    urn = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    block = head + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of one gzip'd or plain WARC record; the payload of a revisit is None."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, payload = b"", block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type", "")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "digest": fields.get("warc-payload-digest"), "payload": None if kind == "revisit" else payload, "payload_bytes": int(length[1]) if kind == "revisit" and length else len(payload),
    }


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


# ---- writing -----------------------------------------------------------------------


class _Package:
    """A ZIP of two stored members, records and their index, written front to back under a name of its own."""

    def __init__(self, folder: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Forward(self.out), 1 << 20), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(DATA_NAME, "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, raw: bytes) -> None:
        self.member.write(raw)
        self.index.append(json.dumps({"offset": self.at, "length": len(raw)}))
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX_NAME, "\n".join(self.index))
        self.zip.close()
        self.zip.fp = None
        self.out.close()
        return self.name, len(self.index), self.at


class _Forward(io.RawIOBase):
    """A stream that cannot seek: what any store takes."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(bytes(b))
        return len(b)


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, n_bytes and refers_to.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response that the others refer to. Smallest ids are found by digest with
    sums made before the shuffle; the join back splits hot digests.
    """
    body = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    first = own.filter(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return own.join(stage(first), "digest", "left").select("page_id", "url", "html", "digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 100, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the manifest: file, records, bytes.

    Each task writes packages under new names and the manifest, which is
    committed as one table, says which of them count; those of lost or repeated
    attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            for page_id, url, html, digest, n, refers_to in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if package is None:
                    package = _Package(folder)
                package.add(record(page_id, url, html.encode() if refers_to is None else None, n, digest, refers_to))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file", "records", "bytes"])

    return stage(revisits(pages, min_bytes).mapInArrow(run, "file string, records long, bytes long"))


# ---- reading -----------------------------------------------------------------------


def ranges(files: DataFrame, folder: str, data_name: str = DATA_NAME, index_name: str = INDEX_NAME, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, offset and lengths of record ranges of about ``range_bytes``, from each package's directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs, base = pafs.FileSystem.from_uri(folder)
            files_, offsets, lengths = [], [], []
            for name in b.column(0).to_pylist():
                path = f"{base}/{name}"
                with fs.open_input_file(path) as f:
                    members = {m.name: m for m in directory(f, f.size())}
                    for need in (data_name, index_name):
                        if need not in members or not members[need].stored:
                            raise ValueError(f"{name}: {need} is missing or compressed; only stored members can be read by range")
                    data, index = members[data_name], members[index_name]
                    start, lines = data_offset(f, data), _read(f, data_offset(f, index), index.size)
                at, own = None, []
                for line in lines.splitlines():
                    x = json.loads(line)
                    if x["offset"] + x["length"] > data.size:
                        raise ValueError(f"{name}: the index points past {data_name}")
                    if own and (sum(own) >= range_bytes or at + sum(own) != x["offset"]):
                        files_.append(name)
                        offsets.append(start + at)
                        lengths.append(own)
                        own = []
                    at = x["offset"] if not own else at
                    own.append(x["length"])
                if own:
                    files_.append(name)
                    offsets.append(start + at)
                    lengths.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(files_, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["file", "offset", "lengths"])

    return files.select("file").mapInArrow(run, "file string, offset long, lengths array<long>")


def read_records(where: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of ``ranges``: record_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload).

    Of a response the length and digest are taken from the payload itself, and
    a digest that its header contradicts is an error; of a revisit they are those its headers state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for b in batches:
            for name, offset, lengths in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    raw = _read(f, offset, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    x = parse_record(raw[at : at + n])
                    at += n
                    stated = (x["digest"] or "").removeprefix("sha256:")
                    digest = stated if x["payload"] is None else hashlib.sha256(x["payload"]).hexdigest()
                    if stated and digest != stated:
                        raise ValueError(f"{name}: {x['record_id']} does not have the payload its digest states")
                    rows.append([x["record_id"], x["url"], x["record_type"], x["refers_to"], x["payload_bytes"], digest, x["payload"]])
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 6 + payloads], names[: 6 + payloads])

    kind = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return where.mapInArrow(run, kind)


def archived(spark: SparkSession, pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes ``pages`` into packages in the shared folder and reads them back.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A null html is an empty payload; a null url has no
    target header; null ids are written as such, are no page's response if the
    payload also has an id, and are all responses otherwise. Rows that repeat
    the smallest id of a payload are all responses. Other columns do not matter.
    """
    folder = shared_folder(spark)
    manifest = write_packages(pages, folder, min_bytes)
    where = stage(ranges(manifest, folder))
    n = max(1, min(where.count(), 100_000))
    got = read_records(where.repartition(n), folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return got.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
