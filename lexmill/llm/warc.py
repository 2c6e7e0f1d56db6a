"""WARC records in ZIP packages: a writer, and a reader that takes records by byte range without extraction.

A package is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` holds the records, each its own
gzip member, and ``indexes/index.cdxj`` one line for each record with its offset and length inside the archive member.
The reader looks for the end-of-central-directory record from the file's end, follows the ZIP64 locator where a field
overflows, parses the central directory, reads the index member and then each record by one ranged read.

Equal payloads of ``min_bytes`` or more are kept once: the record with the smallest id is a response, others are revisit
records that name it. Digests are SHA-1 in base32.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.runtime import bound_batches, materialise, scratch_path

PACKAGE_BYTES, PACKAGES_PER_TASK = 32 << 20, 8
#: Payloads of more rows than this count as shared by very many, as far as their digests fit the broadcast (160 kB).
HOT_ROWS, HOT_PAYLOADS = 500, 4_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_MANIFEST = "package string, size long, records long"
_RECORD = "record_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, payload binary"


# Files: local and file:// paths by the OS, other schemes by the file systems of pyarrow.
def open_read(path: str):
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class Output:
    """Written under a passing name of its own and renamed when whole: a lost task leaves no half file, two do not meet."""

    def __init__(self, path: str):
        self.path, self.local = path, path.startswith("file:") or "://" not in path
        passing = f".{uuid.uuid4().hex}.part"
        if self.local:
            self.name = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
            os.makedirs(os.path.dirname(self.name), exist_ok=True)
            self.part = self.name + passing
            self.file = open(self.part, "wb")
        else:
            from pyarrow import fs

            self.system, self.name = fs.FileSystem.from_uri(path)
            self.part = self.name + passing
            self.file = self.system.open_output_stream(self.part)

    def close(self) -> None:
        self.file.close()
        if self.local:
            os.replace(self.part, self.name)
            return
        from pyarrow import fs

        try:
            self.system.move(self.part, self.name)
        except OSError:  # some file systems do not move onto the file of an earlier attempt
            if self.system.get_file_info(self.name).type == fs.FileType.NotFound:
                raise
            self.system.delete_file(self.part)


# ZIP
@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    packed: int
    size: int


class PackageWriter:
    """Stored ZIP members; sizes and counts beyond the old fields (or ``zip64``) use ZIP64 records."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> None:
        raw, crc, size = name.encode(), 0, 0
        for c in chunks:
            crc, size = zlib.crc32(c, crc), size + len(c)
        start, big = self.at, self.zip64 or size >= 0xFFFFFFFF or self.at >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = 0xFFFFFFFF if big else size
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._put(c)
        self.members.append((raw, crc, size, start, big))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start, big in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            shown, where = (0xFFFFFFFF, 0xFFFFFFFF) if big else (size, start)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64 or begin >= 0xFFFFFFFF or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            n, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, begin, 0))


def _range(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"package ends early: {len(data)} of {n} bytes at {at}")
    return data


def directory(file, size: int) -> dict[str, Member]:
    """Members by name from the central directory; ValueError where there is none."""
    tail = min(size, 65_557)
    data = _range(file, size - tail, tail)
    at = data.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(data[at + 20 : at + 22].ljust(2, b"\xff"), "little") != tail:
        at = data.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, begin, _ = struct.unpack("<IHHHHIIH", data[at : at + 22])
    if 0xFFFFFFFF in (length, begin) or count == 0xFFFF:
        locator = _range(file, size - tail + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        _, _, where, _ = struct.unpack("<IIQI", locator)
        _, _, _, _, _, _, _, count, length, begin = struct.unpack("<IQHHIIQQQQ", _range(file, where, 56))
    raw, at, found = _range(file, begin, length), 0, {}
    for _ in range(count):
        sig, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, header = struct.unpack("<IHHHHHHIIIHHHHHII", raw[at : at + 46])
        if sig != 0x02014B50:
            raise ValueError("broken central directory")
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        found[name] = Member(name, method, header, packed, plain)
        at += 46 + n_name + n_extra + n_note
    return found


def member_start(file, member: Member) -> int:
    """The place of a stored member's first byte."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = _range(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))


# WARC
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(record_id: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'record-{record_id}')}>"


def record(record_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member; a revisit keeps the HTTP head, whose Content-Length is the full payload's.

    A record without a number has no header for it and is named by its url and digest.
    """
    name = f"{url} {digest}" if record_id is None else record_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (b"" if refers_to is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(name)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if record_id is not None:
        lines.append(f"X-Record-Number: {record_id}")
    if url:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}", f"X-Refers-To-Number: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> dict:
    """Fields of one gzip member, with the payload (None for a revisit) and whether its digest is right."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    number, refers = fields.get("x-record-number"), fields.get("x-refers-to-number")
    return {
        "record_id": int(number) if number is not None else None, "target_uri": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": int(refers) if refers is not None else None,
        "verified": len(payload) == size and payload_digest(payload) == digest if response else None, "payload": payload if response else None,
    }


def write_package(path: str, records: list[tuple[int | None, bytes]], zip64: bool = False) -> int:
    out = Output(path)
    at, lines = 0, []
    for number, data in records:
        lines.append(json.dumps({"id": number, "offset": at, "length": len(data)}, separators=(",", ":")))
        at += len(data)
    package = PackageWriter(out.file, zip64)
    package.add(DATA, [d for _, d in records])
    package.add(INDEX, [("\n".join(lines) + "\n").encode()] if lines else [])
    package.close()
    out.close()
    return package.at


def read_package(path: str, size: int, with_payload: bool) -> Iterator[dict]:
    with open_read(path) as file:
        members = directory(file, size)
        data, index = members[DATA], members[INDEX]
        start = member_start(file, data)
        lines = _range(file, member_start(file, index), index.size).decode().splitlines()
        for line in lines:
            entry = json.loads(line)
            got = parse_record(_range(file, start + entry["offset"], entry["length"]))
            yield got if with_payload else got | {"payload": None}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes one record a row into packages below ``folder``; returns the manifest (package, size, records).

    Null html is an empty payload, a null url names no target. Rows of one id with equal payloads are one response and no
    revisits to itself. A row without an id is a record without a number: a revisit where a row with an id has its
    payload, else a response. Payloads that very many rows share are told by a broadcast of at most ``HOT_PAYLOADS``
    digests, so their rows meet in no task; those of the others are joined by digest.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    shared = keyed.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts, _ = materialise(shared, "warc-firsts")
    hot = firsts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "sha").limit(HOT_PAYLOADS).select("sha", F.col("first").alias("hot"))
    near = keyed.join(F.broadcast(hot), "sha", "left")
    key = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat_ws("-", F.lit("hot"), F.xxhash64("id", "url")))
    parted = near.withColumns({"key": key, "html": F.when(F.col("hot") != F.col("id"), F.lit(None)).otherwise(F.col("html")), "size": F.octet_length("html").cast("long")})
    joined = parted.join(firsts.select(F.col("sha").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("hot", "first"))
    refers = F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    told = joined.select("id", "url", refers.alias("refers"), "sha", "size", F.when(refers.isNull(), F.col("html")).alias("html"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, out = [], 0, []

        def flush() -> None:
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            out.append((path, write_package(path, held), len(held)))
            held.clear()

        for b in batches:
            for number, url, refers, sha, size, text in zip(b["id"], b["url"], b["refers"], b["sha"], b["size"], b["html"], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                refer = None if pd.isna(refers) else int(refers)
                own = None if pd.isna(number) else int(number)
                held.append((own, record(own, url or "", (text or "").encode(), int(size), digest, refer)))
                total += len(held[-1][1])
                if total >= PACKAGE_BYTES:
                    flush()
                    total = 0
        if held:
            flush()
        yield pd.DataFrame(out, columns=["package", "size", "records"])

    return materialise(told.mapInPandas(write, _MANIFEST), "warc-manifest")[0]


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of all packages of a manifest (package, size), by ranged reads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in _RECORD.split(", ")]
        for b in batches:
            for path, size in zip(b["package"], b["size"], strict=True):
                rows, held = [], 0
                for got in read_package(path, int(size), with_payload):
                    rows.append(got)
                    held += len(got["payload"] or b"")
                    if len(rows) >= 2048 or held >= 16 << 20:
                        yield _frame(rows, columns)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, columns)

    many = manifest.count()
    tasks = max(1, min(many, max(4 * manifest.sparkSession.sparkContext.defaultParallelism, math.ceil(many / PACKAGES_PER_TASK))))
    # a number of partitions that is asked for is not coalesced by the few bytes of the manifest
    return manifest.select("package", "size").repartition(tasks).mapInPandas(read, _RECORD)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("record_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def round_trip(pages: DataFrame, id_col: str = "page_id", **kwargs) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each page, from the packages written and read back."""
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"), id_col, **kwargs)
    got = read_archives(manifest, with_payload=False)
    checked = F.when(F.coalesce(F.col("verified"), F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload digest mismatch")))
    return got.select(F.col("record_id").alias(id_col), "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def package_bytes(records: list[tuple[int | None, bytes]], zip64: bool = False) -> bytes:
    """A package in memory, for small sets of records."""
    out = io.BytesIO()
    package = PackageWriter(out, zip64)
    at, lines = 0, []
    for number, data in records:
        lines.append(json.dumps({"id": number, "offset": at, "length": len(data)}))
        at += len(data)
    package.add(DATA, [d for _, d in records])
    package.add(INDEX, ["\n".join(lines).encode()])
    package.close()
    return out.getvalue()
