"""Operator 8: WARC archives, written by Spark's text writer and assembled again.

Writing: one row per record, whose text is the record's header, an empty line
and its block; the writer's line separator is the CRLF CRLF that ends a WARC
record, so each part file is an archive (gzip) on any Hadoop file system.
Every page gives a request, a response (or revisit) and a metadata record; the
first and the last name the middle one in WARC-Concurrent-To.

A file is bounded by bytes: pages are written in classes of size, larger ones
with fewer records to a file.  Reading: archives are read as binary files,
unpacked and parsed by Content-Length record by record;
:func:`assemble` joins the records of a transaction through their concurrent-to
identifiers into one nested row per capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, discard, materialise, scratch, ship

CRLF = "\r\n"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _urn(kind: str, key):
    """A stable record id of a page: a name-based UUID form of an MD5."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _head(fields: list[tuple[str, object]]):
    """Header lines; a field whose value is null is left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF))).otherwise(F.lit("")) for k, v in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines)


#: Bytes of the smallest class of pages; a class reaches four times as far as the one before.
SMALL = 65_536


def thin_pages(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``pages`` (id, url, html) with the columns that decide about a record: _bytes, _digest, _key.

    _key names the record: rows that differ in id, url or payload differ in it.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    p = p.withColumns({"_bytes": F.octet_length("html").cast("long"), "_digest": F.sha1(F.col("html").cast("binary"))})
    named = [F.coalesce(F.col("id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("\0")), F.col("_digest")]
    return p.withColumn("_key", F.md5(F.concat_ws(" ", *named)))


def mark_revisits(p: DataFrame, min_bytes: int) -> tuple[DataFrame, list[int]]:
    """``p`` of :func:`thin_pages` with _refers, _target (null: response), _again; and the size classes that occur.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the
    largest id are responses, the others revisit it; a null id is the smallest.
    Only digests that occur twice enter the join; a digest of very many pages is
    summed before the shuffle and its rows are split by the adaptive skew join
    where the digests are too many to broadcast.  _again marks rows that repeat
    another in everything.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.col("_bytes"), F.lit(1)) / SMALL))).cast("int")
    p = p.withColumn("_class", size)
    thin = materialise(p.select("id", "_bytes", "_digest", "_key", "_class"))
    top = F.max(F.struct("id", "_key")).alias("top")
    groups = thin.filter(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(top, F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups.select("_digest", F.col("top.id").alias("_first"), F.col("top._key").alias("_first_key")))
    again = materialise(thin.groupBy("_key").count().filter("count > 1").select("_key", F.lit(True).alias("_again")))
    classes = sorted(r["_class"] for r in thin.select("_class").distinct().collect())
    j = p.join(bounded(groups), "_digest", "left").join(bounded(again), "_key", "left")
    revisits = F.col("_first").isNotNull() & ~F.col("id").eqNullSafe(F.col("_first"))
    j = j.withColumns({"_refers": F.when(revisits, F.col("_first")), "_target": F.when(revisits, F.col("_first_key"))})
    discard(thin)
    return j, classes


def write_archives(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_revisit_bytes: int = 1000,
    pages_per_file: int = 1_000,
    path: str | None = None,
) -> str:
    """Write archives for all pages; returns their folder.

    Null payloads are empty ones.  A null url gives no target URI; line breaks
    in a url are percent-encoded.  Every row is a capture of its own, rows with
    equal or null ids and rows that repeat another in everything included.  A
    file holds ``pages_per_file`` pages of up to 64 KiB, a quarter of that number
    for every quadrupling of the size, and one page of the largest.
    """
    path = path or scratch(pages.sparkSession)
    p, classes = mark_revisits(thin_pages(pages, id_col=id_col, url_col=url_col, payload_col=payload_col), min_revisit_bytes)
    name = F.concat("_key", F.when(F.col("_again"), F.concat(F.lit(" "), F.monotonically_increasing_id().cast("string"))).otherwise(F.lit("")))
    p = p.withColumn("_name", name)
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    main, again = _urn("capture", F.col("_name")), F.col("_target").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    request = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace(url, r"^[A-Za-z]+://[^/]*", ""), F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    note = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(f"{CRLF}payload-bytes: "), F.col("_bytes").cast("string"), F.lit(CRLF),
        F.coalesce(F.concat(F.lit("refers-to-page-id: "), F.col("_refers").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    same = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]

    def record(kind, rid, block, content_type, *more, size=None, carries=None):
        length = size if size is not None else F.octet_length(block)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), *same, *more, ("Content-Type", F.lit(content_type)), ("Content-Length", length)]
        return F.struct(F.concat(_head(fields), F.lit(CRLF), block).alias("front"), (carries if carries is not None else F.lit(False)).alias("carries"))

    # rows are dealt without the payload; it joins its record's front once, where the row is written
    records = F.array(
        record(F.lit("request"), _urn("request", F.col("_name")), request, "application/http; msgtype=request", ("WARC-Concurrent-To", main)),
        record(
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            main,
            http,
            "application/http; msgtype=response",
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
            ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("WARC-Refers-To", F.when(again, _urn("capture", F.col("_target")))),
            size=F.octet_length(http).cast("long") + F.when(again, F.lit(0)).otherwise(F.col("_bytes")),
            carries=~again,
        ),
        record(F.lit("metadata"), _urn("metadata", F.col("_name")), note, "application/warc-fields", ("WARC-Concurrent-To", main)),
    )
    value = F.when(F.col("r.carries"), F.concat("r.front", "html")).otherwise(F.col("r.front"))
    for c in classes or [0]:
        few = 3 * max(1, pages_per_file // 4**c)
        p.filter(F.col("_class") == c).select("html", F.explode(records).alias("r")).select(value.alias("value")).write.mode("append").option("lineSep", CRLF * 2).option(
            "compression", "gzip"
        ).option("maxRecordsPerFile", few).text(path)
    return path


def unpacked(data: bytes, step: int = 1 << 20):
    """Chunks of the plain bytes of an archive; one or more gzip members, or plain."""
    import zlib

    if data[:2] != b"\x1f\x8b":
        yield data
        return
    z, at = zlib.decompressobj(31), 0
    while at < len(data):
        part = data[at : at + step]
        at += len(part)
        while part:
            yield z.decompress(part)
            part = z.unused_data
            if part:
                z = zlib.decompressobj(31)
    yield z.flush()


def parse_archive(chunks):
    """Yield (headers, block) for every record of an archive given as chunks of its plain bytes.

    Holds one record and one chunk at a time.  Several spaces, missing optional
    fields and other header names' case are accepted; a cut-off last record raises.
    """
    held, more = bytearray(), iter(chunks)

    def fill(n):
        while len(held) < n:
            part = next(more, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held or not bytes(held).strip():
            if not fill(len(held) + 1):
                return
            continue
        end = held.find(b"\r\n\r\n")
        while end < 0 and fill(len(held) + 1):
            end = held.find(b"\r\n\r\n")
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        headers = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            headers[k.decode().strip().lower()] = v.decode("utf-8", "replace").strip()
        n = int(headers["content-length"])
        if not fill(end + 4 + n):
            raise ValueError("the archive ends inside a record")
        block = bytes(memoryview(held)[end + 4 : end + 4 + n])
        del held[: end + 4 + n]
        yield headers, block


def read_records(spark, path: str, *, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path``; digests are taken of the read payloads."""
    import pyarrow as pa

    ship(spark)
    schema = pa.schema(
        [(n, pa.string()) for n in RECORD.names[:8]]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
    )

    def rows(batches):
        import hashlib

        for batch in batches:
            for content in batch.column("content"):
                got, size = [], 0
                for h, block in parse_archive(unpacked(content.as_py())):
                    kind, fields, payload = h.get("warc-type"), {}, None
                    if kind in ("response", "request"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                    keep = kind == "response"
                    got.append(
                        {
                            "record_id": h.get("warc-record-id"),
                            "type": kind,
                            "concurrent_to": h.get("warc-concurrent-to"),
                            "refers_to": h.get("warc-refers-to"),
                            "target_uri": h.get("warc-target-uri"),
                            "date": h.get("warc-date"),
                            "stated_digest": h.get("warc-payload-digest", "").partition(":")[2].lower() or None,
                            "payload_digest": hashlib.sha1(payload).hexdigest() if keep else None,
                            "payload_bytes": len(payload) if keep else None,
                            "payload": payload if keep and with_payload else None,
                            "fields": list(fields.items()),
                        }
                    )
                    size += len(payload or b"")
                    if size > 8_000_000 or len(got) >= 2000:
                        yield pa.RecordBatch.from_pylist(got, schema)
                        got, size = [], 0
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit), request, metadata.

    Records meet by the identifier they are concurrent to (their own for a
    response or revisit).  A record whose partner is missing leaves null there;
    of several records of a kind the one with the smallest id is taken.
    """
    r = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))

    def side(*kinds):
        return F.min_by(
            F.when(F.col("type").isin(*kinds), F.struct("record_id", "type", "refers_to", "target_uri", "date", "stated_digest", "payload_digest", "payload_bytes", "payload", "fields")),
            F.when(F.col("type").isin(*kinds), F.col("record_id")),
        )

    return r.groupBy("capture_id").agg(
        side("response", "revisit").alias("response"), side("request").alias("request"), side("metadata").alias("metadata")
    )


def captures(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture read."""
    nested = assemble(read_records(spark, path, with_payload=False))
    page = lambda f: F.expr(f"try_cast(metadata.fields['{f}'] as bigint)")
    flat = nested.select(
        "capture_id",
        page("page-id").alias("page_id"),
        F.coalesce("response.payload_bytes", page("payload-bytes")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.stated_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("target"),
        page("refers-to-page-id").alias("stated"),
    )
    flat = materialise(flat)
    targets = flat.join(flat.filter("target is not null").select(F.col("target").alias("capture_id")).distinct(), "capture_id", "left_semi")
    targets = materialise(targets.select(F.col("capture_id").alias("target"), F.col("page_id").alias("found")))
    # a target that repeats another row in everything has a name of its own; the metadata record tells its page
    return flat.join(bounded(targets), "target", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("found", "stated").alias("refers_to")
    )


def op8_transaction_assembly(spark, sf_dir: str) -> DataFrame:
    return captures(spark, write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.m <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.m <> p.page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
