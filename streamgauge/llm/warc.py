"""WARC archives: writing with revisits, reading, and assembly of transactions (operator 5).

Each capture is written as three records, each a gzip member of its own: a request, a response (or a revisit that names the
response of an equal payload) and a metadata record. The request and the metadata record point to the response by
``WARC-Concurrent-To``. Reading gives one row a record, in any order and from any files; ``assemble`` joins the records
through their concurrent-to identifiers into one nested row a capture.

Of captures with equal payloads of at least ``least_bytes`` bytes, that of the largest key is the response and the others
revisit it. Rows with a null key are responses and never revisited. Of rows that repeat both the largest key and the
payload, all are responses, and revisits refer to one of them; the other record ids hold a random part, so that rows that
repeat a key stay captures of their own. A null payload is empty, a null url gives an empty target, an empty table no
archives and no rows. Payloads are written and read whole, one at a time. Only the key, the url and the payload are read, so
other columns may have any names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import fresh, kept, ship, text_of

_STAMP = "2024-01-01T00:00:00Z"
_KEY = "X-Capture-Key"
RECORD = "record_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, capture_key long, payload_digest string, payload_bytes long, content binary"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", _STAMP), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def _digest(hexadecimal: str) -> str:
    return "sha1:" + hexadecimal


def response_id(key: int | None, chosen: str | None = None) -> str:
    """Id of a response or revisit record: ``chosen`` (a digest) for the one response that others revisit, else a random part."""
    return f"<urn:capture:{'' if key is None else key}:{chosen or uuid.uuid4()}>"


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000) -> list[str]:
    """Write the archives; their paths (one a task that had rows)."""
    spark = pages.sparkSession
    ship(spark)
    folder = fresh(spark, "warc")
    files.make_folder(folder)
    body = F.encode(text_of(payload), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    large = rows.where((F.length("body") >= least_bytes) & F.col("key").isNotNull()).groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))
    large = kept(large, "warc-digests")
    first = large.groupBy("digest").agg(F.max(F.struct("key", "n")).alias("top"), F.sum("n").alias("all")).where("all > 1").select("digest", F.col("top.key").alias("holder"), (F.col("top.n") == 1).alias("sole"))
    marks = kept(large.join(first, "digest").select(F.col("key").alias("of"), "holder", "sole", F.col("digest").alias("same")), "warc-revisits")
    rows = rows.join(marks, (F.col("key") == F.col("of")) & (F.col("digest") == F.col("same")), "left").drop("of", "same")
    rows = rows.withColumn("chosen", (F.col("holder") == F.col("key")) & F.col("sole"))
    if marks.where("of = holder and not sole").take(1):
        # the largest key repeats: its rows are stored with a mark each, and the row of the least mark is the one to refer to
        many = (F.col("holder") == F.col("key")) & ~F.col("sole")
        again = kept(rows.where(many).withColumn("mark", F.expr("uuid()")), "warc-repeated")
        least = again.groupBy(F.col("digest").alias("_d"), F.col("key").alias("_k")).agg(F.min("mark").alias("_least"))
        again = again.join(least, (F.col("digest") == F.col("_d")) & (F.col("key") == F.col("_k"))).withColumn("chosen", F.col("mark") == F.col("_least"))
        rows = rows.where(~F.coalesce(many, F.lit(False))).unionByName(again.drop("mark", "_d", "_k", "_least"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = files.own_name(folder, "archive") + ".warc.gz", None
        for batch in batches:
            if batch.num_rows and out is None:
                out = files.open_write(name)
            for r in batch.to_pylist():
                revisit = r["holder"] is not None and r["holder"] != r["key"]
                rid, target = response_id(r["key"], r["digest"] if r["chosen"] else None), r["url"].replace("\r", "%0D").replace("\n", "%0A")
                common = [("WARC-Target-URI", target)] + ([(_KEY, str(r["key"]))] if r["key"] is not None else [])
                stated = [("WARC-Payload-Digest", _digest(r["digest"]))]
                if revisit:
                    headers = [("WARC-Record-ID", rid), *common, *stated, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", response_id(r["holder"], r["digest"])), ("Content-Type", "application/http; msgtype=response")]
                    main = _record("revisit", headers, b"HTTP/1.1 200 OK\r\n\r\n")
                else:
                    main = _record("response", [("WARC-Record-ID", rid), *common, *stated, ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + r["body"])
                also = [("WARC-Concurrent-To", rid), *common]
                request = _record("request", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *also, ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\n\r\n")
                about = _record("metadata", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *also, ("Content-Type", "application/warc-fields")], f"payloadLength: {len(r['body'])}\r\n".encode())
                out.write(request + main + about)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return sorted(r.name for r in rows.mapInArrow(archive, "name string").collect())  # a row a file


def members(stream: io.RawIOBase, step: int = 1 << 20, slice_: int = 1 << 14) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one after another.

    The stream is read in steps and fed to the decoder in slices, so that what a member leaves over, and is copied, is less
    than a slice.
    """
    data, at = memoryview(b""), 0
    while True:
        engine, out = zlib.decompressobj(31), []
        while not engine.eof:
            if at == len(data):
                data, at = memoryview(stream.read(step)), 0
                if not len(data):
                    if out:
                        raise ValueError("the archive ends within a record")
                    return
            part = data[at : at + slice_]
            out.append(engine.decompress(part))
            at += len(part) - len(engine.unused_data)
        yield b"".join(out)


def parse(record: bytes, with_content: bool) -> tuple:
    """A row of ``RECORD`` from one record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, list[str]] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda name: fields.get(name, [None])[0]
    block = block[: int(one("content-length") or 0)]
    kind, digest, size = one("warc-type"), one("warc-payload-digest"), None
    digest = digest.removeprefix("sha1:") if digest else None
    content = block
    if kind == "response":
        content = block.partition(b"\r\n\r\n")[2]
        size = len(content)
        if digest and digest != hashlib.sha1(content).hexdigest():
            raise ValueError(f"the payload of {one('warc-record-id')} differs from its digest")
    elif kind == "metadata":
        stated = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        size = int(stated["payloadLength"]) if "payloadLength" in stated else None
    key = one(_KEY.lower())
    return kind, one("warc-record-id"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), int(key) if key is not None else None, digest, size, content if with_content else None


def read(spark: SparkSession, names: list[str], with_content: bool = True) -> DataFrame:
    """A row a record. Without content, payloads are measured and checked but not passed on."""
    ship(spark)
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    titles = [c.strip().split(" ")[0] for c in RECORD.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=titles)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                with files.open_read(name) as f:
                    found, held = [], 0
                    for m in members(f):
                        found.append(parse(m, with_content))
                        held += len(m) if with_content else 1000
                        if held > 4_000_000:
                            yield out(found)
                            found, held = [], 0
                    if found:
                        yield out(found)

    return files.each_file(spark, [(n,) for n in names], "name string", rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, request, response (a response or revisit record), metadata.

    A record belongs to the capture of the response or revisit that it names, that names it, or that a record it names
    names. Joins are by sorting: what Spark knows of the size of records read from archives is the size of the list of files.
    Records of no capture are left out; of several requests (or metadata records) of a capture the one with the
    least id is taken.
    """
    main = F.col("record_type").isin("response", "revisit")
    named = records.select("record_id", "record_type", F.explode_outer("concurrent_to").alias("to"))
    heads = named.where(main).select("record_id").distinct()
    others = named.where(~main & F.col("record_type").isin("request", "metadata"))
    direct = others.join(heads.withColumnRenamed("record_id", "to").hint("merge"), "to", "left_semi").select("record_id", F.col("to").alias("capture_id"))
    reverse = named.where(main & F.col("to").isNotNull()).select(F.col("to").alias("record_id"), F.col("record_id").alias("capture_id"))
    first = direct.unionByName(reverse).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    second = others.join(first.select("record_id").hint("merge"), "record_id", "left_anti").where("to is not null").join(first.select(F.col("record_id").alias("to"), "capture_id").hint("merge"), "to").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    owner = first.unionByName(second).unionByName(heads.select("record_id", F.col("record_id").alias("capture_id")))
    body = F.struct(*[c for c in records.columns])
    own = records.join(owner.hint("merge"), "record_id")
    pick = lambda kinds: F.min_by(F.when(F.col("record_type").isin(*kinds), body), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))
    return own.groupBy("capture_id").agg(pick(["request"]).alias("request"), pick(["response", "revisit"]).alias("response"), pick(["metadata"]).alias("metadata")).where("response is not null")
