"""WARC archives of pages: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import keep, shared_folder

#: Ranges of a file closer than this are read at once, up to READ bytes.
GAP = 1 << 16
READ = 8 << 20
#: Bytes of a file that one task reads.
SHARE = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset long, length long, url string, digest string, page_id long, kind string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Of a URI or a plain path. Written and read by tasks on any machine."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header_value(text: str | None) -> str:
    """One line, without what would end it; percent signs make it readable again."""
    return re.sub(r"[%\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, sha: str) -> bytes:
    """A gzip member with one WARC/1.1 record; a revisit has no payload."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    data = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + head + payload + b"\r\n\r\n"
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(data) + pack.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload."""
    head, _, rest = zlib.decompress(member, wbits=31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, kind, refers_to)``: the first of equal payloads of at least
    ``min_bytes`` bytes, by page_id, is a response, the others revisit it."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # Only payloads that occur twice say something; one narrow row each.
    first = (
        pages.select(F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).alias("html"))
        .filter(F.octet_length("html") >= min_bytes)
        .select("page_id", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("k"))
        .groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    joined = rows.join(first, F.col("sha") == F.col("k"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write archives below ``folder``; the kept index ``(file, offset, length, url, digest, page_id, kind, refers_to)``.

    A task writes one file under a name of its own. A task that is run again writes
    another file; the index names the files of the runs that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, out, offset = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                rows = []
                for r in batch.to_pylist():
                    payload = r["html"].encode("utf-8", "surrogatepass")
                    sha = digest(payload)
                    member = record(r["page_id"], r["url"], payload, r["kind"], r["refers_to"], sha)
                    out.write(member)
                    rows.append({"file": name, "offset": offset, "length": len(member), "url": r["url"], "digest": sha, "page_id": r["page_id"], "kind": r["kind"], "refers_to": r["refers_to"]})
                    offset += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=_index_schema())
        finally:
            if out is not None:
                out.close()

    return keep(decide(pages, min_bytes).mapInArrow(write, _INDEX), "warc-index")


def _index_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _INDEX.split(", "))])


def read_archives(selected: DataFrame, folder: str) -> DataFrame:
    """Records of the index rows ``selected``: ``(page_id, url, kind, refers_to, digest, payload)``,
    as the archives have them.

    Ranges of a file are sorted by offset, those close to each other are read at
    once. A file is cut into shares of bytes, so a large one is read by many tasks.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(rows):
                file, start, length = rows[at]
                end, last = start + length, at + 1
                while last < len(rows) and rows[last][0] == file and rows[last][1] - end <= GAP and rows[last][1] + rows[last][2] - start <= READ:
                    end = max(end, rows[last][1] + rows[last][2])
                    last += 1
                with system.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(end - start, start)
                found = [read_record(data[o - start : o - start + n]) for _, o, n in rows[at:last]]
                yield pa.RecordBatch.from_pylist([_fields(f, p) for f, p in found], schema=pa.schema(fields))
                at = last

    ranges = selected.select("file", "offset", "length", F.floor(F.col("offset") / SHARE).alias("share"))
    sorted_ranges = ranges.repartition("file", "share").sortWithinPartitions("file", "offset")
    return sorted_ranges.mapInArrow(
        read, "page_id long, url string, kind string, refers_to long, digest string, payload binary"
    )


def _fields(head: dict[str, str], payload: bytes) -> dict:
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None
    url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if m[1] == "25" or int(m[1], 16) < 32 or m[1] == "7F" else m[0], head["WARC-Target-URI"])
    return {
        "page_id": number(head["WARC-Record-ID"]), "url": url, "kind": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")),
        "digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload if head["WARC-Type"] == "response" else None,
    }


def archive(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write ``pages`` to archives in the shared folder: the index, and the folder."""
    folder = f"{shared_folder(pages.sparkSession)}/llm-warc-{uuid.uuid4().hex}"
    return write_archives(pages, folder, min_bytes), folder


def page_digests(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages(page_id, url, html)``, read all of it back, and return
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per page.

    A null html is an empty payload; a null url an empty one. Equal payloads under
    the smallest page_id twice are responses both; a null page_id comes last, and if
    all are null all are responses. The size and digest of a response are those of the payload read
    back; a revisit has them from the response it refers to. Other columns are not
    looked at; an empty table gives an empty one.
    """
    index, folder = archive(pages, min_bytes)
    payload = F.col("payload")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column("payload").to_pylist()
            sizes = pa.array([None if p is None else len(p) for p in payloads], pa.int64())
            shas = pa.array([None if p is None else digest(p) for p in payloads], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "kind", "refers_to", "digest")), sizes, shas],
                names=["page_id", "kind", "refers_to", "digest", "bytes", "sha"],
            )

    found = keep(
        read_archives(index, folder).select("page_id", "kind", "refers_to", "digest", payload).mapInArrow(
            measure, "page_id long, kind string, refers_to long, digest string, bytes long, sha string"
        ),
        "records",
    )
    # A page's response: the digest tells two of a repeated page_id apart.
    referred = found.filter("kind = 'revisit'").select(F.col("refers_to").alias("r"), F.col("digest").alias("d")).distinct()
    sizes = (
        found.filter("kind = 'response'").join(referred, (F.col("page_id") == F.col("r")) & (F.col("sha") == F.col("d")))
        .groupBy("r", "d").agg(F.first("bytes").alias("full"), F.first("sha").alias("full_sha"))
    )
    return found.join(sizes, (F.col("refers_to") == F.col("r")) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.coalesce("sha", "full_sha").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )
