"""WARC writing, reading and transaction assembly.

Each capture is a transaction of three records: its request, its response (a revisit, if an earlier capture had the same
payload) and its metadata; request and metadata name the response in WARC-Concurrent-To. Archives are gzip members, one for
a record, in files of bounded size. They are written through ``pyarrow.fs`` under names of the attempt's own; only files in
the manifest count. Reading parses records wherever they lie; a join on the identifiers assembles one nested row for each capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiqua.llm._common import cut, new_folder, scratch, settled

#: Payloads of fewer bytes are stored each time; archives are closed beyond this many bytes.
LEAST_REVISIT, ARCHIVE_BYTES = 100, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, n_records long, n_bytes long"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, fields map<string,string>, declared string, payload_bytes long, payload_digest string, payload binary"
BROADCAST_ROWS = 1_000_000


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *((k, v) for k, v in headers if v is not None), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


#: The header that says of a target that its line breaks, and its percent signs, are percent-encoded.
ENCODED = "X-Target-Line-Breaks"
#: Bytes of HTTP headers, at most: a block that has none within so many is all payload.
HEADER_BYTES = 1 << 20


def _breaks(text: str) -> bool:
    return "\r" in text or "\n" in text


def _line(text: str) -> str:
    """A header's value: line breaks would end it. Only a text with line breaks is encoded."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if _breaks(text) else text


def _unlined(text: str) -> str:
    return text.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def _text(data: bytes) -> str:
    """A header's text: UTF-8, or else Latin-1."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def first_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {digest}'.encode()).hexdigest())}"


def planned(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest`` with ``first`` (the record that others revisit) and ``revisit``.

    Digests are counted over all pages; of rows with a payload's smallest page id one is the response. Only digests that
    occur twice or more are joined back.
    """
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("_size"))
    seen = pages.filter(F.col("_size") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("c"), F.min("page_id").alias("_least")).filter("c > 1")
    seen = cut(seen.select(F.col("digest").alias("_d"), "_least"), "payloads")
    sent = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    joined = pages.join(sent, F.col("digest") == F.col("_d"), "left").withColumn("_is", F.col("_d").isNotNull() & F.col("page_id").eqNullSafe(F.col("_least")))
    tied = cut(pages.filter(F.col("_size") >= LEAST_REVISIT).groupBy("digest", "page_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("digest").alias("_td"), F.col("page_id").alias("_tp")), "ties")
    plain = joined.withColumn("first", F.col("_is"))
    if not tied.isEmpty():
        small = F.broadcast(tied) if tied.count() <= BROADCAST_ROWS else tied
        same = (F.col("digest") == F.col("_td")) & F.col("page_id").eqNullSafe(F.col("_tp"))
        among = joined.join(small, same, "left_semi").withColumn("first", F.col("_is") & (F.row_number().over(Window.partitionBy("digest", "page_id").orderBy(F.asc_nulls_last("url"))) == 1))
        plain = plain.join(small, same, "left_anti").unionByName(among)
    return plain.select("page_id", "url", "html", "digest", F.col("first"), (F.col("_d").isNotNull() & ~F.col("first")).alias("revisit"), "_least")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives; returns the manifest.

    A null html is an empty payload, a null url leaves out the target. Repeated rows are captures each; of those with one
    payload and the smallest page id one is the response. Payloads are written whole, each from memory. Other columns are not
    read, whatever their names. No rows: no archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, name, n, size = None, "", 0, 0
        done: list[dict] = []

        def close() -> None:
            out.close()
            done.append({"archive": name, "n_records": n, "n_bytes": size})

        for batch in batches:
            for page_id, url, html, digest, first, revisit, least in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit", "_least")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                payload, uri, own = (html or "").encode(), None if url is None else _line(url), first_id(page_id, digest) if first else f"urn:uuid:{uuid.uuid4()}"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                target = [("WARC-Target-URI", uri), (ENCODED, "percent" if _breaks(url or "") else None)]
                more = [*target, ("WARC-Payload-Digest", f"sha256:{digest}")]
                after = [("WARC-Concurrent-To", f"<{own}>"), *target]
                if revisit:
                    main = _record("revisit", own, [*more, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{first_id(least, digest)}>"), ("Content-Type", "application/http; msgtype=response")], http)
                else:
                    main = _record("response", own, [*more, ("Content-Type", "application/http; msgtype=response")], http + payload)
                host = (url or "").partition("://")[2]
                request = _record("request", f"urn:uuid:{uuid.uuid4()}", [*after, ("Content-Type", "application/http; msgtype=request")], f"GET /{_line(host.partition('/')[2])} HTTP/1.1\r\nHost: {_line(host.partition('/')[0])}\r\n\r\n".encode())
                meta = _record("metadata", f"urn:uuid:{uuid.uuid4()}", [*after, ("Content-Type", "application/warc-fields")], (f"page_id: {page_id}\r\n" if page_id is not None else "").encode())
                for record in (request, main, meta):
                    out.write(record)
                    n, size = n + 1, size + len(record)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return cut(planned(pages).mapInArrow(run, MANIFEST), "archives")


class Archive:
    """An archive's bytes in order, from gzip members or as they are; what is held is a piece of a megabyte or two."""

    def __init__(self, stream):
        self.stream, self.left = stream, stream.read(1 << 20)
        self.packed = self.left[:2] == b"\x1f\x8b"
        self.opened, self.inside, self.out, self.at = zlib.decompressobj(31), False, b"", 0
        if not self.packed:
            self.out, self.left = self.left, b""

    def _more(self) -> bool:
        """Append to what is at hand; false at the end."""
        self.out, self.at = self.out[self.at :], 0
        if not self.packed:
            data = self.stream.read(1 << 20)
            self.out += data
            return bool(data)
        while True:
            data = self.left or self.stream.read(1 << 20)
            if not data and not self.inside:
                return False
            self.inside = True
            new = self.opened.decompress(data, 1 << 20)  # without data: what it still holds
            if not data and not new and not self.opened.eof:
                raise ValueError("an archive ends within a record")
            self.left = self.opened.unconsumed_tail
            if self.opened.eof:
                self.left, self.opened, self.inside = self.opened.unused_data, zlib.decompressobj(31), False
            if new:
                self.out += new
                return True

    def take(self, n: int) -> bytes:
        """The next bytes, up to ``n``; fewer only at the end of what is at hand."""
        if self.at == len(self.out):
            self._more()
        data = self.out[self.at : self.at + n]
        self.at += len(data)
        return data

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What comes before ``mark``, which is passed over; none if it isn't within ``most`` bytes. Nothing is passed over then."""
        low = self.at
        while (found := self.out.find(mark, low, self.at + most + len(mark))) < 0:
            seen = len(self.out) - self.at
            if seen >= most + len(mark) or not self._more():
                return None
            low = self.at + max(0, seen - len(mark) + 1)
        data = self.out[self.at : found]
        self.at = found + len(mark)
        return data


def _named(lines: list[bytes]) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (_text(x).partition(":") for x in lines if x)}


def records_of(stream, with_payload: bool) -> Iterator[dict]:
    """An archive's records. Digest and size are those of the payload that each holds, read in pieces; a revisit holds none.

    A block that is no HTTP message (a ``dns:`` response, say) is all payload. What isn't a WARC record, or has another length
    than it declares, is an error.
    """
    archive = Archive(stream)
    while True:
        first = archive.until(b"\r\n", HEADER_BYTES)
        if first is None:
            if archive.take(1):
                raise ValueError("not a WARC record")
            return
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = archive.until(b"\r\n\r\n", HEADER_BYTES)
        named = {k.lower(): v for k, v in _named((head or b"").split(b"\r\n")).items()}
        if "content-length" not in named:
            raise ValueError("a record's length is not declared")
        left = int(named["content-length"])
        kind, bare = named.get("warc-type", ""), lambda k, named=named: named[k].strip("<>") if k in named else None
        fields, block = {}, None
        if kind in ("request", "response", "revisit") and named.get("content-type", "application/http").startswith("application/http"):
            http = archive.until(b"\r\n\r\n", min(left - 4, HEADER_BYTES)) if left >= 4 else None
            if http is not None:
                left -= len(http) + 4
                fields = _named(http.split(b"\r\n")[1:])
        payload, size, digest, held = kind in ("response", "resource"), left, hashlib.sha256(), []
        while left:
            if not (block := archive.take(min(left, 1 << 20))):
                raise ValueError("an archive ends within a record")
            left -= len(block)
            if payload:
                digest.update(block)
            if kind == "metadata" or payload and with_payload:
                held.append(block)
        if left or b"".join((archive.take(1), archive.take(1), archive.take(1), archive.take(1))) != b"\r\n\r\n":
            raise ValueError("a record's length is not what it declares")
        if kind == "metadata":
            fields = _named(b"".join(held).split(b"\r\n"))
        target = named.get("warc-target-uri")
        yield {
            "record_id": bare("warc-record-id"), "type": kind, "concurrent_to": bare("warc-concurrent-to"), "refers_to": bare("warc-refers-to"), "target_uri": _unlined(target) if target and named.get(ENCODED.lower()) == "percent" else target, "date": named.get("warc-date"), "fields": list(fields.items()),
            "declared": named.get("warc-payload-digest"), "payload_bytes": size if payload else None, "payload_digest": digest.hexdigest() if payload else None, "payload": b"".join(held) if payload and with_payload else None,
        }


_ARROW = pa.schema([(c, pa.string()) for c in ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date")] + [("fields", pa.map_(pa.string(), pa.string())), ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_records(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives, gzip or plain. A damaged archive, or a payload that doesn't have its declared SHA-256, is an error.

    Payloads are read in pieces; with ``with_payload`` each is then held whole, as the value of its row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for row in records_of(f, with_payload):
                        if row["payload_digest"] and (row["declared"] or "").startswith("sha256:") and row["declared"] != f"sha256:{row['payload_digest']}":
                            raise ValueError(f"{name}: {row['record_id']} doesn't have its digest")
                        rows.append(row)
                        size += len(row["payload"] or b"") + 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return manifest.select("archive").repartition(max(manifest.count(), 1)).mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, type, target_uri, date, page_id, payload_bytes, payload_digest, payload, refers_to``
    (page id of the response), and the structs ``request``, ``response`` and ``metadata``.

    Requests and metadata find their response by the identifier they are concurrent to, revisits find the response they refer
    to; a missing part is null, and of several one is taken (the smallest identifier).
    """
    records = records.alias("r")
    main = records.filter("type IN ('response', 'revisit')")
    part = lambda kind: records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias(f"_{kind}")).agg(F.min_by(F.struct("record_id", "fields"), "record_id").alias(kind))
    whole = main.join(part("request"), F.col("record_id") == F.col("_request"), "left").join(part("metadata"), F.col("record_id") == F.col("_metadata"), "left")
    whole = whole.withColumn("page_id", F.expr("try_cast(element_at(metadata.fields, 'page_id') AS long)"))
    asked = whole.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("_asked")).distinct()
    given = whole.join(asked, F.col("record_id") == F.col("_asked"), "left_semi").select(F.col("record_id").alias("_given"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_payload"))
    joined = whole.join(given, F.col("refers_to") == F.col("_given"), "left")
    return joined.select(
        F.col("record_id").alias("capture_id"), "type", "target_uri", "date", "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "_digest").alias("payload_digest"), F.coalesce("payload", "_payload").alias("payload"),
        F.col("_page").alias("refers_to"), "request", F.struct("record_id", "fields").alias("response"), "metadata",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    with scratch() as made:
        manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
        records = settled(read_records(manifest, folder, with_payload=False), "records", [*made, folder])
    return captures(records).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLES = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS f FROM p WHERE n >= {LEAST_REVISIT} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN f.f IS NULL OR f.f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f.f <> page_id THEN f.f END AS refers_to FROM p LEFT JOIN f USING (d)
"""
}
