"""Web archives: WARC records in ZIP packages, written once and range-read through their indexes.

An archive is a ZIP file whose members are stored, not compressed: ``archive/*.warc.gz`` (one gzip member for each
record) and ``indexes/*.cdxj`` (a line for each record with the file it is in, its offset and length; ``.cdx`` and gzip too).  The reader finds the
end-of-directory record, follows the ZIP64 locator where there is one, parses the central directory, finds indexes and archives by it, and reads the index
members and then runs of records by range; nothing is extracted.  Packages of other writers are read too: ids and digests of other
forms are null or not checked.

Of rows with equal payloads of at least ``least_bytes`` the smallest id is a response, larger ids revisit it; rows of
that same smallest id are all responses.  A null payload is an empty one.  A null id counts as larger than every id and stays
null.  Texts of any length are one record each.  Archives lie in the shared folder; one that a failed task began is in no
manifest, so it is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import importable, shared_dir, shuffle_partitions, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID = "urn:voxloom:page:"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- writing -------------------------------------------------------------------------------------


def _header(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the HTTP header of the response it stands for, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Writer:
    """One archive: records are streamed into the data member, the index member follows at the end."""

    def __init__(self, stream):
        self.stream, self.lines, self.at = stream, [], 0
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, raw: bytes, url: str | None) -> None:
        packed = _gzip(raw)
        self.data.write(packed)
        self.lines.append((_header(url or "-").replace(" ", "%20"), self.at, len(packed)))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as index:
            for url, offset, length in self.lines:
                index.write((f"{url} 20240101000000 " + json.dumps({"offset": offset, "length": length, "filename": DATA}) + "\n").encode())
        self.zip.close()
        self.stream.close()


def _write(folder: str, most_bytes: int, most_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        writer, path, n, made = None, "", 0, []
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(k)[r].as_py() for k, c in enumerate(b.schema.names)}
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    path, n, writer = f"{folder}/{name}", 0, Writer(fs.open_output_stream(f"{base}/{name}"))
                payload = b"" if row["refers_to"] is not None else (row["html"] or "").encode()
                writer.add(record(row["page_id"], row["url"], payload, row["size"], row["digest"], row["refers_to"]), row["url"])
                n += 1
                if writer.at >= most_bytes or n >= most_records:
                    made.append((path, n, writer.at))
                    writer.close()
                    writer = None
        if writer is not None:
            made.append((path, n, writer.at))
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), *(pa.array([m[k] for m in made], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, least_bytes: int = 100, most_bytes: int = 1 << 28, most_records: int = 200_000) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); the manifest (path, records, bytes) of the archives."""
    spark = pages.sparkSession
    importable(spark)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    # Copies are counted map-side first; only digests of two rows or more come back, and a hot one is split by the join.
    copies = p.where(f"size >= {least_bytes}").groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("digest", "original")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("original")), F.col("original"))
    rows = p.join(copies, "digest", "left").select("page_id", "url", "html", "digest", "size", F.when(F.col("size") >= least_bytes, refers).alias("refers_to"))
    folder = f"{shared_dir(spark)}/archives"
    return written(rows.mapInArrow(_write(folder, most_bytes, most_records), "path string, records long, bytes long"), "manifest")


# --- reading -------------------------------------------------------------------------------------


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP archive: name to (method, stored size, size, offset of the local header).  ``read(offset, length)`` reads a range."""
    tail = min(size, 22 + 65_535)
    end = read(size - tail, tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", end[at + 10 : at + 20])
    where = size - tail + at
    if where >= 20 and (locator := read(where - 20, 20))[:4] == b"PK\x06\x07":
        zip64 = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if zip64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, offset = struct.unpack("<QQQ", zip64[32:56])
    central, out, p = read(offset, length), {}, 0
    for _ in range(count):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", central[p + 10 : p + 12])[0]
        packed, plain, n, m, k = struct.unpack("<IIHHH", central[p + 20 : p + 34])
        local = struct.unpack("<I", central[p + 42 : p + 46])[0]
        name, extra = central[p + 46 : p + 46 + n].decode("utf-8", "replace"), central[p + 46 + n : p + 46 + n + m]
        e = 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[e : e + 4])
            if tag == 1:
                wide = [struct.unpack("<Q", extra[i : i + 8])[0] for i in range(e + 4, e + 4 + width - 7, 8)]
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + width
        out[name] = (method, packed, plain, local)
        p += 46 + n + m + k
    return out


def member(read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Offset and length of a stored member's bytes."""
    method, packed, _, local = entry
    if method != 0:
        raise ValueError("the member is compressed; records in it can't be read by range")
    head = read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n, m = struct.unpack("<HH", head[26:30])
    return local + 30 + n + m, packed


def located(read, size: int) -> dict[str, tuple[int, list[tuple[int, int]]]]:
    """Archive members that the package's indexes name: offset of the member's bytes, and (offset, length) of its records in order."""
    members = directory(read, size)
    indexes = sorted(n for n in members if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdxj", ".cdx")))
    if not indexes:
        raise ValueError("the package has no index")
    spans: dict[str, list[tuple[int, int]]] = {}
    for name in indexes:
        at, length = member(read, members[name])
        lines = read(at, length)
        for line in (gzip.decompress(lines) if name.endswith(".gz") else lines).splitlines():
            _, brace, rest = line.partition(b"{")
            entry = json.loads(brace + rest) if brace else {}
            if "offset" in entry and "length" in entry:
                spans.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    found = {}
    for file, of in spans.items():
        name = next((n for n in (file, f"archive/{file}") if n in members), None)
        if name is None:
            raise ValueError(f"the index names {file}, which is not in the package")
        found[name] = (member(read, members[name])[0], sorted(of))
    return found


def parse(raw: bytes) -> dict:
    """One record of a gzip member."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    number = lambda v: int(n) if v and (n := v.strip("<>").removeprefix(ID)).removeprefix("-").isdigit() else None
    revisit = fields["warc-type"] == "revisit"
    own, _, given = fields.get("warc-payload-digest", "").partition(":")
    digest = hashlib.sha256(payload).hexdigest() if not revisit else given if own == "sha256" else None
    if own == "sha256" and digest != given:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size if revisit else len(payload), "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload": None if revisit else payload,
    }


def _ranges(run_bytes: int):
    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = _open(path)
                with fs.open_input_file(name) as f:
                    files = located(lambda o, n: f.read_at(n, o), f.size())  # noqa: B023
                starts, lengths = [], []
                for base, spans in files.values():
                    first = 0
                    for k, (o, n) in enumerate(spans):
                        # Records of a run follow each other without a gap, so that one range holds them all.
                        if k + 1 == len(spans) or o + n - spans[first][0] >= run_bytes or spans[k + 1][0] != o + n:
                            starts.append(spans[first][0] + base)
                            lengths.append([m for _, m in spans[first : k + 1]])
                            first = k + 1
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts)), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    return run


def _records(with_payload: bool):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, name = _open(row["path"])
                with fs.open_input_file(name) as f:
                    raw = f.read_at(sum(row["lengths"]), row["start"])
                at, out = 0, []
                for n in row["lengths"]:
                    r = parse(zlib.decompress(raw[at : at + n], 31))
                    r["payload"] = r["payload"].decode("utf-8", "replace") if with_payload and r["payload"] is not None else None
                    out.append(r)
                    at += n
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def read_archives(manifest: DataFrame, with_payload: bool = True, run_bytes: int = 1 << 21) -> DataFrame:
    """Every record of the archives whose ``path`` is listed: runs of about ``run_bytes`` are dealt to all tasks."""
    spark = manifest.sparkSession
    importable(spark)
    runs = manifest.select("path").repartition(shuffle_partitions(spark)).mapInArrow(_ranges(run_bytes), "path string, start long, lengths array<long>")
    out = runs.repartition(shuffle_partitions(spark)).mapInArrow(_records(with_payload), RECORD)
    return out if with_payload else out.drop("payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h) as n, sha256(h) as d, min(page_id) over (partition by h) as m from p)
select page_id, n::bigint as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id > m then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id > m then m end as refers_to
from q
"""
