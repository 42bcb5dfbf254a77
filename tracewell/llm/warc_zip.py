"""ZIP-packaged web archives: WARC records in stored ZIP members with indexes, written by tasks and
read back by byte ranges.

The writer makes packages of archive/data.warc.gz, each record a gzip member of its own, and
indexes/index.cdxj, both stored without further compression.  The reader takes any package: it parses
the end record, the ZIP64 records and the central directory, finds the stored archives (.warc and
.warc.gz, any number of them) and indexes (.cdxj, .cdx, plain or gzipped), and then reads single records
by their byte range; nothing is extracted.  An archive that no index names is walked record by record.
Members that the package compresses cannot be read by ranges and are an error.  Packages live in a
folder that all executors share, reached through its URI.

Cases: a null html is an empty payload; a null url leaves out the target; equal payloads below the
least size are all responses; repeated rows with the smallest page_id are all responses; rows without
a page_id never are what others refer to; rows that share a page_id but not the html are judged one by
one; an empty table makes no package and gives an empty result; further columns are ignored.
"""

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
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stash

# Names of members, and the signatures and sizes of ZIP records.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# ------------------------------------------------------------------ records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, gzipped.  A revisit has no payload but says its digest and length."""
    block = HTTP + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, payload) of all records in a range: plain ones, and those within gzip members,
    of which each may hold several."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        parts.append(unpack.decompress(data) + unpack.flush())
        if not unpack.eof:
            raise ValueError("archive ends within a record")
        data = unpack.unused_data
    raw, at = b"".join([*parts, data]), 0
    while raw[at:].strip(b"\r\n"):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        at = end + 4 + int(head["content-length"])
        block = raw[end + 4 : at]
        # The payload follows the HTTP head, where there is one.
        cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
        yield head, block[cut + 4 :]
        at += 4


def walk(read, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive of `size` bytes that has no index: gzip members
    end where their stream does, plain records where their headers say."""
    at = 0
    while at < size:
        data = read(at, min(step, size - at))
        if data[:2] == b"\x1f\x8b":
            unpack, used = zlib.decompressobj(31), 0
            while True:
                unpack.decompress(data)
                used += len(data) - len(unpack.unused_data)
                if unpack.eof:
                    break
                data = read(at + used, min(step, size - at - used))
                if not data:
                    raise ValueError("archive ends within a record")
            yield at, used
            at += used
            continue
        head = data[: data.index(b"\r\n\r\n") + 4]
        body = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
        length = len(head) + body + 4
        yield at, length
        at += length


# ------------------------------------------------------------------ packages


def package(rows: list[tuple], zip64: bool = False) -> bytes:
    """A package of (page_id, url, payload, digest, refers_to) rows."""
    out, index = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(DATA, "w", force_zip64=zip64) as f:
            at = 0
            for page_id, url, payload, digest, refers_to in rows:
                data = record(page_id, url, payload, digest, refers_to)
                f.write(data)
                entry = {"url": url, "digest": f"sha256:{digest}", "filename": DATA.rpartition("/")[2], "offset": str(at), "length": str(len(data))}
                index.append(f"{sort_key(url)} 20240101000000 {json.dumps(entry)}")
                at += len(data)
        z.writestr(INDEX, "\n".join(sorted(index)) + "\n")
    return out.getvalue()


def sort_key(url: str | None) -> str:
    """Host labels in reverse, then the path: the order of index lines; - without a url."""
    found = re.match(r"(?i)[a-z]+://([^/?#\s]+)([^\s]*)", url or "")
    return f"{','.join(reversed(found[1].lower().split('.')))}){found[2] or '/'}" if found else "-"


def indexed(data: bytes, name: str) -> Iterator[tuple[str, int, int]]:
    """(archive, offset, length) of the lines of an index member; lines without all three are passed
    over, as are header lines."""
    text = (gzip.decompress(data) if name.endswith(".gz") else data).decode("utf-8")
    for line in text.split("\n"):
        at = line.find("{")
        if at >= 0 and not line.startswith("!"):
            entry = json.loads(line[at:])
            if {"filename", "offset", "length"} <= entry.keys():
                yield str(entry["filename"]), int(entry["offset"]), int(entry["length"])


def records(read, found: dict[str, tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(offset in the package, length) of all records of a package with these members, in order: those that indexes
    name, and what lies between them."""
    archives = {n: m for n, m in found.items() if n.endswith((".warc", ".warc.gz"))}
    indexes = {n: m for n, m in found.items() if n.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))}
    for name, (method, _, _) in (archives | indexes).items():
        if method:
            raise ValueError(f"{name} is compressed by the package, not stored")
    # Indexes name archives by their whole names or the last parts of these; a name that fits several is
    # of no use, and what no index names is walked.
    ends: dict[str, list[str]] = {}
    for n in archives:
        for i in [0, *(k + 1 for k, c in enumerate(n) if c == "/")]:
            ends.setdefault(n[i:], []).append(n)
    named: dict[str, set[tuple[int, int]]] = {n: set() for n in archives}
    for name, (_, at, size) in indexes.items():
        for archive, offset, length in indexed(read(at, size), name):
            fits = [archive] if archive in archives else ends.get(archive, [])
            if len(fits) == 1:
                named[fits[0]].add((offset, length))
    out: set[tuple[int, int]] = set()
    for name, (_, at, size) in archives.items():
        done = 0
        for offset, length in [*sorted(named[name]), (size, 0)]:
            if offset > done:
                gap = at + done
                out |= {(gap + o, n) for o, n in walk(lambda a, n: read(gap + a, n), offset - done)}  # noqa: B023
            if length:
                out.add((at + offset, length))
            done = max(done, offset + length)
    return sorted(out)


def members(read, size: int) -> dict[str, tuple[int, int, int]]:
    """{name: (method, offset of the data, stored size)} of a package, from its directories alone.
    read(offset, length) gives bytes; size is that of the whole file."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end record: not a ZIP package")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator = at - 20
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        (where,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
        end = read(where, 56)
        if end[:4] != END64:
            raise ValueError("broken ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, full = struct.unpack("<II", directory[at + 20 : at + 28])
        n_name, n_extra, n_comment = struct.unpack("<HHH", directory[at + 28 : at + 34])
        (local,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                big = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = big.pop(0) if full == 0xFFFFFFFF else full
                packed = big.pop(0) if packed == 0xFFFFFFFF else packed
                local = big.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        head = read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        own_name, own_extra = struct.unpack("<HH", head[26:30])
        found[name] = (method, local + 30 + own_name + own_extra, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


# ------------------------------------------------------------------ Spark


def _write(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)

    def put(rows: list[tuple]) -> pa.RecordBatch:
        name, data = f"{uuid.uuid4().hex}.wacz", package(rows)
        with where.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(rows)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "n_records", "n_bytes"])

    rows, held = [], 0
    for batch in batches:
        for part in batch.to_pylist():
            payload = (part["html"] or "").encode("utf-8")
            rows.append((part["page_id"], part["url"], payload, part["digest"], part["refers_to"]))
            held += len(payload) + 512
            if held >= most:
                yield put(rows)
                rows, held = [], 0
    if rows:
        yield put(rows)


def write_packages(pages: DataFrame, folder: str, least: int = 100, most: int = 16 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as packages of about `most` bytes into the folder; the packages
    that count: path, n_records, n_bytes.  A payload of `least` bytes or more that a smaller page_id
    also has becomes a revisit.  A retried task writes new packages, and only those of tasks that
    ended well are listed."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"))
    short = pages.where(F.col("n") >= least).select("page_id", "digest")
    firsts = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies >= 2").select("digest", "first")
    # Html never meets by digest, which may be that of a third of all pages: the revisits are found
    # among ids alone, and joined to the pages by id.
    again = short.join(firsts, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = stash(again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), F.col("first").alias("refers_to")), "revisits")
    same = pages["page_id"].eqNullSafe(F.col("again_id")) & (pages["digest"] == F.col("again_digest"))
    rows = pages.join(again, same, "left").select("page_id", "url", "html", "digest", "refers_to")
    return stash(rows.mapInArrow(partial(_write, folder=folder, most=most), "path string, n_records long, n_bytes long"), "packages")


def _ranges(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_file(name) as f:
                read = lambda at, n: f.read_at(n, at)  # noqa: E731, B023
                try:
                    entries = records(read, members(read, f.size()))
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
            groups, room = [], 0
            for at, n in entries:
                if not groups or room + n > most:
                    groups.append([])
                    room = 0
                groups[-1].append((at, n))
                room += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(groups)), pa.array([[x[0] for x in g] for g in groups], pa.list_(pa.int64())), pa.array([[x[1] for x in g] for g in groups], pa.list_(pa.int64()))],
                ["path", "offsets", "lengths"],
            )


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for part in batch.to_pylist():
            where, name = fs.FileSystem.from_uri(part["path"])
            rows = []
            with where.open_input_file(name) as f:
                for at, n in zip(part["offsets"], part["lengths"]):
                    for head, payload in parse_records(f.read_at(n, at)):
                        kind = head["warc-type"]
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        digest, size = head.get("warc-payload-digest", "").removeprefix("sha256:"), int(head.get("payload-length") or 0)
                        if kind != "revisit":
                            size, own = len(payload), hashlib.sha256(payload).hexdigest()
                            # Digests by other algorithms are not checked but replaced.
                            if not re.fullmatch("[0-9a-f]{64}", digest):
                                digest = own
                            if own != digest:
                                raise ValueError(f"{part['path']}: digest differs at {at}")
                        number = lambda key: int(head[key]) if head.get(key) else None  # noqa: E731, B023
                        rows.append((number("page-id"), head.get("warc-target-uri"), size, digest, kind, number("refers-to-page"), payload if payloads else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_packages(packages: DataFrame, most: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """One row per response, resource or revisit of the packages (path): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null with payloads=False).  page_id, refers_to and
    the size of a revisit's payload are there if the record's headers say them.
    Directories and indexes are read first; records are then dealt out in ranges of about `most`
    bytes, so that a large package is read by many tasks."""
    spark = packages.sparkSession
    spread = spark.sparkContext.defaultParallelism * 4
    ranges = packages.select("path").repartition(spread, "path").mapInArrow(partial(_ranges, most=most), "path string, offsets array<long>, lengths array<long>")
    ranges = ranges.repartition(spread, "path", F.element_at("offsets", 1))
    return ranges.mapInArrow(partial(_read, payloads=payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def package_folder(spark) -> str:
    """A new folder for packages below the shared one."""
    where = shared_dir(spark)
    return f"{where if '://' in where else 'file://' + where}/packages-{uuid.uuid4().hex}"
