"""WARC archives: writing, and normalising a monolithic gzip stream.

``write_archives`` writes plain WARC records, one gzip stream a file, as many
crawlers do.  ``normalise`` inflates such a stream once, from begin to end and
in bounded memory, and rewrites every record as a gzip member of its own, with
a sidecar of one line a record: byte offset, byte length, record id, type.
``read_records`` reads records by the sidecars alone.

Equal payloads of at least ``LEAST`` bytes are stored once, in the response of
the smallest page_id; the others are revisit records without a payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import store

LEAST = 100
LEVEL = 1
CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else int(page_id)}>"


def page_of(value: str | None) -> int | None:
    """Page id in a record id."""
    inner = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record with an HTTP response, or a revisit of one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    safe_url = "".join(c for c in url or "" if c > " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {safe_url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(data: bytes) -> tuple[dict[str, str], int]:
    """Named fields of a record's head and where its block begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a WARC record must begin with its version")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def inflated(stream) -> Iterator[bytes]:
    """Contents of a gzip stream of one or more members, a chunk at a time.

    A stream that ends inside a member is an error; zero bytes after a member are padding.
    """
    engine, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):  # zeros between and after members are padding
                break
            begun = True
            yield engine.decompress(data, 4 * CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data, begun = engine.unused_data, False
                engine = zlib.decompressobj(31)
    if begun:
        raise ValueError("the stream ends inside a gzip member")


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of WARC bytes; holds one record and a chunk."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            fields, begin = headers_of(bytes(held[: end + 4]))
            need = begin + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the stream ends inside a record")


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def roles(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the payloads that revisit another page's.

    A page_id may come with several payloads; each is judged by itself.  Only
    digests are grouped, after each task has taken its own minimum.
    """
    seen = store.staged(pages.select("page_id", _digest().alias("digest")).where("page_id is not null and digest is not null"), "digests")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return seen.join(first, "digest").where("page_id <> refers_to").distinct()


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def _digest() -> Column:
    """SHA-256 of a payload that is long enough to be revisited, else null."""
    return F.when(F.octet_length(_payload()) >= LEAST, F.unhex(F.sha2(_payload(), 256)))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write one record a row into monolithic gzip archives below ``path``; returns their manifest (path, records).

    Null html is an empty payload, null url an empty one.  Rows with a null
    page_id are responses.  Rows that repeat a page_id keep a record each, with
    another payload or the same.  An empty table gives no archive.
    """
    spark = pages.sparkSession
    found = roles(pages)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _payload().alias("html"), _digest().alias("digest"))
    dealt = rows.join(found, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to").withColumn("part", F.spark_partition_id())

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((f for f in frames if len(f)), None)
        if first is None:
            return
        uri, n = f"{path}/crawl-{int(first['part'].iloc[0]):06d}.warc.gz", [0]

        def fill(stream) -> None:
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            for frame in (f for some in ([first], frames) for f in some):
                for page_id, url, html, refers_to in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"], strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = refers_to is not None and refers_to == refers_to
                    stream.write(engine.compress(record(None if page_id != page_id else page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to, revisit)))
                    n[0] += 1
            stream.write(engine.flush())

        store.put_whole(uri, fill)
        yield pd.DataFrame({"path": [uri], "records": n})

    manifest = dealt.mapInPandas(write, "path string, records long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite archives (column path) so that every record is its own gzip member.

    Each file's stream is inflated once.  Beside ``<name>`` goes ``<name>.idx``.
    Returns the manifest: path, index, records.  No archives give an empty one.
    """
    spark = archives.sparkSession

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source in frame["path"]:
                uri, lines = f"{path}/{source.rsplit('/', 1)[-1]}", []

                def fill(stream, source=source, lines=lines) -> None:
                    filesystem, place = store.open_fs(source)
                    at = 0
                    with filesystem.open_input_stream(place, compression=None) as whole:
                        for data in records_of(inflated(whole)):
                            fields, _ = headers_of(data)
                            one = member(data)
                            stream.write(one)
                            lines.append(f"{at}\t{len(one)}\t{fields['warc-record-id']}\t{fields['warc-type']}\n")
                            at += len(one)

                store.put_whole(uri, fill)
                store.put_whole(f"{uri}.idx", lambda stream, lines=lines: stream.write("".join(lines).encode()))
                yield pd.DataFrame({"path": [uri], "index": [f"{uri}.idx"], "records": [len(lines)]})

    manifest = archives.select("path").repartition(max(1, archives.count())).mapInPandas(rewrite, "path string, index string, records long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records below ``path`` by their sidecars: page_id, url, record_type,
    refers_to, payload_bytes and payload_digest (of the full payload), payload
    (null for revisits).  A response whose payload doesn't have its digest fails.
    """
    files = spark.read.schema("path string, index string, records long").parquet(f"{path}/manifest")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, index in zip(frame["path"], frame["index"], strict=True):
                filesystem, place = store.open_fs(index)
                with filesystem.open_input_stream(place, compression=None) as stream:
                    lines = stream.read().decode().splitlines()
                filesystem, place = store.open_fs(uri)
                with filesystem.open_input_file(place) as file:
                    rows, size = [], 0
                    for line in lines:
                        offset, length = map(int, line.split("\t")[:2])
                        data = zlib.decompress(file.read_at(length, offset), 31)
                        rows.append(_row(data))
                        size += len(data)
                        if size > 8_000_000:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=_COLUMNS)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return files.repartition(max(1, files.count())).mapInPandas(read, schema).withColumns({c: F.col(c) for c in ("page_id", "refers_to")})


_COLUMNS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def _row(data: bytes) -> tuple:
    fields, begin = headers_of(data)
    block = data[begin : begin + int(fields["content-length"])]
    http = block.index(b"\r\n\r\n") + 4
    length = int(next(x.split(b":")[1] for x in block[:http].split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    payload = None if revisit else block[http:]
    if payload is not None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], page_of(fields.get("warc-refers-to")), length, digest, payload
