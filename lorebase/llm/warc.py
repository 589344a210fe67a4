"""WARC archives: writing with revisits, segments and chunked framing, and
reading with segment reassembly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_shuffles, materialize, new_path, sent_if_few

#: Most bytes of a record's block; longer ones go on in continuation records.
SEGMENT = 1 << 16
#: Bytes of a chunk of transfer framing.
CHUNK = 1 << 13
#: Records of an archive file, so that a file is read whole by one task.
RECORDS = 2000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

FIELDS = "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, segment int, origin_id string, total_length long, payload_bytes long"
READ = f"{FIELDS}, block binary, payload binary, problem string"


def digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The content of chunked transfer framing; ValueError where it breaks off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing decoded."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def classified(pages: DataFrame) -> DataFrame:
    """_uid, page_id, url, payload, and the page_id and _uid of the response
    that holds the same payload (_to): the largest page_id, among rows that
    repeat it the one written last."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("_uid"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = materialize(rows.withColumn("_sha", F.sha1("payload")), "warc-pages")
    mine = F.struct("page_id", "_uid")
    best = rows.groupBy(F.col("_sha").alias("_k"), F.length("payload").alias("_n")).agg(F.max(mine).alias("_best"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    # Payloads are shuffled only if the classes of copies are too many to send to them.
    j = rows.join(sent_if_few(materialize(best, "warc-copies")), (F.col("_sha") == F.col("_k")) & (F.length("payload") == F.col("_n")), "left")
    return j.select("_uid", "page_id", "url", "payload", F.coalesce("_best", mine).alias("_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) to
    gzip-compressed archives in folder ``path``.

    Equal payloads have one response; the others are revisit records that name
    it. A response's block is an HTTP message with chunked framing; beyond
    ``segment`` bytes it goes on in continuation records, which land in any
    archive. Null html is an empty payload, a null url an empty one, null ids
    and repeated rows get records of their own; other columns are ignored.
    """

    def name(page: int | None, uid: int) -> str:
        return f"<urn:page:{'' if page is None else page}:{uid}>"

    def record(block: bytes, **fields: object) -> bytes:
        lines = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
        return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                out = []
                for uid, page, url, payload, to in zip(*(whole.slice(low, 256).column(i).to_pylist() for i in range(5)), strict=True):
                    me, response = name(page, uid), name(to["page_id"], to["_uid"])
                    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                    sha = f"sha1:{digest(payload)}"
                    common = {"WARC_Record_ID": me, "WARC_Date": "2024-01-01T00:00:00Z", "WARC_Target_URI": url}
                    if uid != to["_uid"]:
                        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                        out.append(record(b"", WARC_Type="revisit", **common, WARC_Payload_Digest=sha, WARC_Refers_To=response, WARC_Profile=profile))
                        continue
                    block = HTTP + chunked(payload)
                    kind = {"WARC_Type": "response", **common, "WARC_Payload_Digest": sha, "Content_Type": "application/http;msgtype=response"}
                    if len(block) <= segment:
                        out.append(record(block, **kind))
                        continue
                    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                    out.append(record(parts[0], **kind, WARC_Segment_Number=1))
                    for k, part in enumerate(parts[1:], 2):
                        total = len(block) if k == len(parts) else None
                        own = common | {"WARC_Record_ID": me[:-1] + f":{k}>"}
                        out.append(record(part, WARC_Type="continuation", **own, WARC_Segment_Origin_ID=me, WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # A record ends with two line ends, which the text writer puts after each row; it copies bytes as they are.
    records = classified(pages).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive; after a broken one, from the next that begins."""
    while data[:2] == b"\x1f\x8b":  # one member after another
        members = []
        while data:
            d = zlib.decompressobj(31)
            try:
                members.append(d.decompress(data) + d.flush())
            except zlib.error:
                break
            data = d.unused_data
        data = b"".join(members)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            at = data.find(b"WARC/1.", at)
            if at < 0:
                yield {"record_type": "malformed", "problem": "no record begins here"}
                return
        end = data.find(b"\r\n\r\n", at)
        fields = {}
        if end >= 0:
            for line in data[at:end].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            yield {"record_type": "malformed", "problem": "no length, or cut short"}
            at += 7
            continue
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4
        number = lambda k: int(fields[k]) if fields.get(k, "").isdigit() else None
        yield {
            "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
            "refers_to_id": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest"), "segment": number("warc-segment-number"),
            "origin_id": fields.get("warc-segment-origin-id"), "total_length": number("warc-segment-total-length"), "block": block,
        }


def _decoded(r: dict) -> dict:
    try:
        payload = http_payload(r["block"])
        if (want := r.get("payload_digest")) and want != f"sha1:{digest(payload)}":
            return r | {"block": None, "payload": payload, "payload_bytes": len(payload), "problem": "the digest differs"}
        return r | {"block": None, "payload": payload, "payload_bytes": len(payload)}
    except ValueError as e:
        return r | {"problem": str(e)}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in READ.split(", "))])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (see READ), segments
    joined and payloads decoded; without ``payloads`` these are only measured
    and checked.

    Segments are grouped by the identifier of their first record, ordered by
    number and joined; where a number is missing or the length is not the total
    that the last one states, ``problem`` says so and payload is null, as it is
    for broken framing. Records that are no responses have no payload. Only
    segmented records are shuffled.
    """
    schema = _schema()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in parse_archive(content.as_py()):
                    if r["record_type"] == "response" and r["segment"] is None:
                        r = _decoded(r)
                    rows.append(r if payloads else r | {"payload": None})
                    held += len(rows[-1].get("payload") or rows[-1].get("block") or b"")
                    if held > 1 << 24:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                yield _batch(rows, schema)

    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 32):
                rows = []
                for r in b.slice(low, 32).to_pylist():
                    parts = r.pop("parts")
                    block = b"".join(p["block"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                        rows.append(r | {"problem": "a segment is missing"})
                    elif r["total_length"] != len(block):
                        rows.append(r | {"problem": f"{len(block)} bytes of {r['total_length']}"})
                    else:
                        r = _decoded(r | {"block": block, "segment": None})
                        rows.append(r if payloads else r | {"payload": None})
                yield _batch(rows, schema)

    records = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, READ), "warc-records")
    split = records.where("segment is not null")
    part = F.struct("segment", "block")
    first = F.col("segment") == 1
    fields = [F.max(F.when(first, F.col(c))).alias(c) for c in ("record_id", "record_type", "target_uri", "refers_to_id", "payload_digest")]
    joined = split.groupBy(F.coalesce("origin_id", "record_id").alias("_o")).agg(*fields, F.max("total_length").alias("total_length"), F.sort_array(F.collect_set(part)).alias("parts")).drop("_o")
    return records.where("segment is null").unionByName(joined.mapInArrow(rejoin, READ))


def round_trip(pages: DataFrame, path: str | None = None, segment: int = SEGMENT, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for revisits): ``pages`` written to archives and read back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, segment)
    free_shuffles(spark)
    found = read_archives(spark, path, payloads).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*):', 1), '') as bigint)")
    sizes = found.where("record_type = 'response'").select(F.col("record_id").alias("_r"), F.col("payload_bytes").alias("_n"))
    j = found.join(sizes, F.col("refers_to_id") == F.col("_r"), "left")
    return j.select(
        page("record_id").alias("page_id"), F.col("target_uri").alias("url"), F.coalesce("payload_bytes", "_n").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to_id").alias("refers_to"), "payload", "problem",
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x, max(page_id) OVER (PARTITION BY b) AS m FROM p
), d AS (
  SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1), '' ORDER BY i)
             FROM range(32) t(i)) AS payload_digest FROM h
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM d
"""
