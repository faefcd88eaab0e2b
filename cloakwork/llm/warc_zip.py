"""WARC records in ZIP packages: a writer, and a reader that finds and reads records by byte ranges.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, in which each WARC 1.1 record is a gzip
member of its own, ``indexes/index.cdxj``, with one line for each page (key, timestamp, JSON with offset and length in that
archive), and ``datapackage.json``, which lists both. The reader takes the end-of-central-directory record from the file's
tail (ZIP64 locator and record too), parses the central directory, reads each wanted member's local header to find where its
bytes begin, and then reads index and records as ranges of the package: nothing is extracted, and a worker holds one record
at a time. Packages of others are read too: with several archives, archives that aren't compressed, indexes with or without
keys; without a plain index the archives are scanned record by record.

Payloads that repeat are written once: of the rows with equal payloads of at least ``least_bytes`` bytes, the one with the
largest id is a ``response``, the others are ``revisit`` records that refer to its record; smaller payloads are all responses.
A record holds an HTTP message; the payload is its body, and a revisit has the head only. Groups are counted by SHA-1 digest,
with partial sums before the shuffle, so a payload that a third of the rows share is no hot group; the payloads themselves
are joined to their group by digest, which adaptive execution can split.

Reading computes size and digest of every payload that there is. ``checked`` compares revisits with the records that they
refer to; groups of revisits with the same claim are one row there, so a hot payload isn't a hot key.

Packages go to the shared folder under names that no other task attempt uses; only the packages that successful tasks
report are read, so lost executors and repeated attempts leave at most unread files. ``round_trip`` deletes them once read.

Defined results: null html is an empty payload; equal rows (same id and payload) are all responses if their id is the
group's largest, under one record id; a null id is never the largest unless all ids of the group are null, and then all are
responses; null and empty urls get a name made of the id and are read as null; an empty table gives no packages and no rows.
Of archives of others, records of other types (warcinfo, request, metadata) are skipped, rows have a null page_id, a
revisit's size is what its HTTP head says, or null, and ``verified`` is null where nothing tells a digest. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import shared_dir, small_batches, written
from cloakwork.session import Scratch, remove

ARCHIVE, INDEX, LISTING = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for the url of a page without one.
NAMELESS = "urn:x-page:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# ---- ZIP ---------------------------------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


def members(file) -> list[Member]:
    """The entries of the central directory of a seekable binary file, ZIP64 included."""
    file.seek(0, 2)
    length = file.tell()
    back = min(length, 22 + 0xFFFF)
    file.seek(length - back)
    tail = file.read(back)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # a signature inside the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        if at < 20 or tail[at - 20 : at - 16] != b"PK\x06\x07":
            raise ValueError("ZIP64 sizes without a ZIP64 locator")
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        file.seek(where)
        record = file.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where the locator points")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    file.seek(offset)
    directory = file.read(size)
    found, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, full = struct.unpack_from("<II", directory, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        (header_at,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # wide values, only of those fields that are all ones, in this order
                wide, k = extra[4 : 4 + n], 0
                for field in ("full", "stored", "header_at"):
                    if {"full": full, "stored": stored, "header_at": header_at}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", wide, k)
                        k += 8
                        full, stored, header_at = (value if field == f else v for f, v in (("full", full), ("stored", stored), ("header_at", header_at)))
            extra = extra[4 + n :]
        found.append(Member(name, method, full, stored, header_at))
        at += 46 + n_name + n_extra + n_comment
    return found


def data_at(file, m: Member) -> int:
    """Where a stored member's bytes begin: its local header may have another extra field than the directory."""
    if m.method:
        raise ValueError(f"{m.name} is compressed in the package; only stored members can be read by ranges")
    file.seek(m.header_at)
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return m.header_at + 30 + n_name + n_extra


# ---- WARC --------------------------------------------------------------------------------------------------------------


def record_bytes(headers: dict[str, str], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(body))}).items()) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 1, mtime=0)


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, compressed or not."""
    head, _, rest = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(lines)
    return headers, rest[: int(headers["content-length"])]


def _dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (size := int(body[at:end].split(b";")[0] or b"0", 16)):
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, dict[str, str]]:
    """A record's payload, and the fields of its HTTP head if it has one: the block behind that head, without chunk marks."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block, {}
    head, gap, body = block.partition(b"\r\n\r\n")
    http = _fields(head.split(b"\r\n")[1:])
    return (_dechunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body), http


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def sort_key(url: str) -> str:
    """The key of an index line: the host's labels from the last one, then port, path and query, in lower case."""
    found = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)", url.lower())
    key = ",".join(reversed(found[1].split("."))) + (found[2] or "") + ")" + (found[3] or "/") if found else url.lower()
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02x}", key)


class Package:
    """Writes one package. ``file`` needs write only; offsets are counted here."""

    def __init__(self, file, name: str, date: str):
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.lines, self.sha, self.date = 0, [], hashlib.sha256(), date
        self.info = f"<urn:uuid:{uuid.uuid4()}>"
        said = b"software: cloakwork\r\nformat: WARC File Format 1.1\r\n"
        self._put({"WARC-Type": "warcinfo", "WARC-Record-ID": self.info, "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, said)

    def _put(self, headers: dict[str, str], block: bytes) -> int:
        raw = record_bytes(headers, block)
        self.archive.write(raw)
        self.sha.update(raw)
        self.at += len(raw)
        return len(raw)

    def add(self, headers: dict[str, str], block: bytes) -> None:
        """A page's record, which gets a line in the index."""
        offset = self.at
        length = self._put(headers | {"WARC-Date": self.date, "WARC-Warcinfo-ID": self.info, "Content-Type": "application/http; msgtype=response"}, block)
        url, mime = headers["WARC-Target-URI"], "text/html" if headers["WARC-Type"] == "response" else "warc/revisit"
        told = {"url": url, "mime": mime, "status": "200", "digest": headers["WARC-Payload-Digest"], "length": str(length), "offset": str(offset), "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{sort_key(url)} {re.sub(r'[^0-9]', '', self.date)[:14]} {json.dumps(told)}\n")

    def close(self) -> None:
        self.archive.close()
        index = "".join(sorted(self.lines)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        parts = [(ARCHIVE, self.sha.hexdigest(), self.at), (INDEX, hashlib.sha256(index).hexdigest(), len(index))]
        resources = [{"name": n.rpartition("/")[2], "path": n, "hash": f"sha256:{h}", "bytes": size} for n, h, size in parts]
        self.zip.writestr(zipfile.ZipInfo(LISTING), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "created": self.date, "resources": resources}))
        self.zip.close()


def records(file, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a package's archive members (of those with a plain index, the indexed ones), each read as a range."""
    found = {m.name: m for m in members(file)}
    archives = {n.rpartition("/")[2]: m for n, m in sorted(found.items()) if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
    indexes = [m for n, m in sorted(found.items()) if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx")) and not m.method]
    if not indexes or any(n.endswith(".cdx.gz") for n in found):
        for m in archives.values():
            yield from _unindexed(file, data_at(file, m), m.size, step)
        return
    bases = {n: data_at(file, m) for n, m in archives.items()}
    for m in indexes:
        at, left, part = data_at(file, m), m.size, b""
        while left:
            file.seek(at)
            got = file.read(min(step, left))
            at, left = at + len(got), left - len(got)
            *lines, part = (part + got).split(b"\n")
            # The last line may have no newline.
            for line in lines if left else [*lines, part]:
                brace = line.find(b"{")
                if brace < 0 or line.startswith(b"!"):
                    continue  # blank, or about the index itself
                entry = json.loads(line[brace:])
                base = bases[entry["filename"].rpartition("/")[2]] if "filename" in entry else next(iter(bases.values()))
                file.seek(base + int(entry["offset"]))
                yield parse_record(file.read(int(entry["length"])))


def _unindexed(file, at: int, left: int, step: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive member without an index, one after another: gzip members, or plain records."""

    def more() -> bytes:
        nonlocal at, left
        if not left:
            raise ValueError("the archive ends inside a record")
        file.seek(at)
        got = file.read(min(step, left))
        at, left = at + len(got), left - len(got)
        return got

    part = b""
    while left or part:
        part = part or more()
        if part[:1] == b"\x1f":
            z, raw = zlib.decompressobj(31), []
            while not z.eof:
                part = part or more()
                raw.append(z.decompress(part))
                part = z.unused_data
            yield parse_record(b"".join(raw))
            continue
        part = part.lstrip(b"\r\n")
        if not part:
            continue
        while (end := part.find(b"\r\n\r\n")) < 0:
            part += more()
        size = end + 4 + int(_fields(part[:end].split(b"\r\n")[1:])["content-length"])
        held, have = [part], len(part)
        while have < size:
            held.append(more())
            have += len(held[-1])
        part = b"".join(held)
        yield parse_record(part[:size])
        part = part[size:]


# ---- Spark -------------------------------------------------------------------------------------------------------------


def base32(sha1_hex: Column) -> Column:
    """Upper-case base-32 of a SHA-1 in hexadecimal: five digits give four characters."""
    alphabet = F.array(*[F.lit(c) for c in BASE32])
    parts = []
    for i in range(8):
        value = F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 10).cast("int")
        parts += [F.get(alphabet, F.shiftright(value, shift).bitwiseAND(31)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def assign(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest (base 32), record_type and refers_to for every row."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    large = pages.select(F.col(page_id).alias("page_id"), payload.alias("payload")).where(F.length("payload") >= least_bytes).select("page_id", F.sha1("payload").alias("sha"))
    # Only payloads that come more than once need a group; the others are responses.
    groups = large.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("sha", "top")
    joined = rows.join(written(groups, "payload-groups"), "sha", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select(
        "page_id", "url", "payload", base32(F.col("sha")).alias("digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"),
    )


def _target(folder: str):
    """A pyarrow file system and the folder's path in it. Where pyarrow has none for the folder, this raises."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    return "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write(assigned: DataFrame, folder: str | None = None, most_bytes: int = 32 << 20, date: str | None = None) -> DataFrame:
    """Writes packages of about ``most_bytes`` of archive each; one row per package: path and records.

    date: of all records (WARC-Date, in UTC); the time of the call if not given.
    """
    spark = assigned.sparkSession
    folder = _uri(folder or f"{shared_dir(spark)}/cloakwork/warc-{uuid.uuid4().hex}")
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    space = uuid.uuid4()  # record ids follow from it, the page and the payload, so a revisit can name a record of another package
    small_batches(spark)
    sent = assigned.select(F.col("page_id").cast("string"), "url", "payload", "digest", "record_type", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _target(folder)
        system.create_dir(base, recursive=True)
        package = sink = path = None
        done, n = [], 0
        named = lambda page, digest: f"<urn:uuid:{uuid.uuid5(space, f'{page}:{digest}')}>"

        def close() -> None:
            package.close()
            sink.close()
            done.append((path, n))

        for batch in batches:
            for page, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    sink, n = system.open_output_stream(path), 0
                    package = Package(sink, path.rpartition("/")[2], date)
                again = kind == "revisit"
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"{NAMELESS}{page}"
                headers = {
                    "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if again else named(page, digest), "WARC-Target-URI": uri,
                    "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": json.dumps(page),
                }
                if again:
                    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": named(refers, digest), "WARC-Refers-To-Date": date, "X-Refers-To-Page-ID": json.dumps(refers)}
                package.add(headers, http_head(len(payload)) + (b"" if again else payload))
                n += 1
                if package.at >= most_bytes:
                    close()
                    package = None
        if package is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rpartition('/')[2]}" for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return written(sent.mapInArrow(run, "path string, records bigint"), "packages")


#: Types of records that hold a page.
PAGES = ("response", "resource", "revisit")
RECORD = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, record_id string, refers_to_record string, verified boolean"


def read(packages: DataFrame, page_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """One row per page record of the packages in column ``path``: the columns of RECORD, and ``payload`` if asked for.

    Sizes and digests of payloads are computed from what was read; ``verified`` tells whether the header's digest agrees.
    Those of revisits are what their heads claim; ``checked`` compares them.
    """
    small_batches(packages.sparkSession)
    schema = RECORD + (", payload binary" if payloads else "")

    def rows(path: str) -> Iterator[tuple]:
        folder, _, name = path.rpartition("/")
        system, base = _target(folder)
        with system.open_input_file(f"{base}/{name}") as file:
            for headers, block in records(file):
                kind = headers.get("warc-type")
                if kind not in PAGES:
                    continue
                body, http = payload_of(headers, block)
                told = re.fullmatch(r"sha1:([A-Z2-7]{32})", headers.get("warc-payload-digest", ""))
                if kind == "revisit":
                    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                    digest, verified = told and told[1], None
                else:
                    size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    verified = digest == told[1] if told else None
                url = headers.get("warc-target-uri", "").strip("<>")
                page, refers = (json.loads(headers.get(k, "null")) for k in ("x-page-id", "x-refers-to-page-id"))
                yield page, size, digest, kind, refers, url if url and not url.startswith(NAMELESS) else None, headers.get("warc-record-id"), headers.get("warc-refers-to"), verified, *([body] if payloads else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += (len(row[-1]) if payloads else 0) + 400
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    # One package is one unit of work, as packages are of bounded size.
    n = packages.count()
    dealt = packages.select("path").repartition(max(1, n)) if n else packages.select("path")
    out = dealt.mapInArrow(run, schema)
    return out.withColumns({"page_id": F.col("page_id").cast(page_type), "refers_to": F.col("refers_to").cast(page_type)})


def checked(found: DataFrame) -> DataFrame:
    """What is wrong among read records: (record_id, claims, fault), no rows if nothing is.

    Faults: ``payload`` (a digest that differs from its header), ``refers`` (a revisit whose response isn't among the records)
    and ``claim`` (one that says another digest, size or page than its response has). Revisits with the same claim are one row.
    """
    broken = found.where(~F.col("verified")).groupBy("record_id").agg(F.count("*").alias("claims")).select("record_id", "claims", F.lit("payload").alias("fault"))
    said = found.where("record_type = 'revisit'").groupBy(F.col("refers_to_record").alias("record_id"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"), F.col("refers_to").alias("p")).agg(F.count("*").alias("claims"))
    there = found.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("r")).agg(F.min("payload_digest").alias("rd"), F.min("payload_bytes").alias("rn"), F.min("page_id").alias("rp"))
    met = said.join(there, F.col("record_id") == F.col("r"), "left")
    # A size or page that an archive doesn't tell claims nothing.
    agrees = (F.col("d") == F.col("rd")) & F.coalesce(F.col("n") == F.col("rn"), F.lit(True)) & F.coalesce(F.col("p") == F.col("rp"), F.lit(True))
    wrong = met.where(F.col("r").isNull() | ~F.coalesce(agrees, F.lit(False))).select("record_id", "claims", F.when(F.col("r").isNull(), "refers").otherwise("claim").alias("fault"))
    return broken.unionByName(wrong)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC packages, reads every record back, and compares revisits with their responses; a fault raises."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    scratch = Scratch(spark, "warc-records")
    folder = f"{scratch.folder}-packages"
    found = scratch.written(read(write(assign(pages, least_bytes), folder), kind, payloads=False), "records")
    remove(spark, _uri(folder))  # all of it is read
    if wrong := checked(found).limit(5).collect():
        raise ValueError(f"records that disagree: {wrong}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
