"""WARC archives: a monolithic gzip stream is inflated once and rewritten with one member per record and an offset index."""

from __future__ import annotations

import atexit
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads under so many bytes are always stored; equal ones from here on are stored once.
LEAST_SHARED = 100
#: Bytes of payload after which a writer begins its next file.
ROLL_BYTES = 256_000_000
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value)


def urn(page_id) -> str:
    """A record's name from its page_id: other signs than letters, digits and -._~ in hex; none at all for a null one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def named(name: str | None) -> str | None:
    """The page_id of a record's name, as text."""
    return unquote(name[10:-1]) if name and name.startswith("<urn:page:") else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head alone, and the full payload's size and digest in its headers."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    block = HTTP if revisit else HTTP + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]) if k}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut inflated bytes into whole records, holding one record at a time."""
    held, need = bytearray(), -1
    for chunk in stream:
        held += chunk
        while True:
            if need < 0:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not at the beginning of a WARC record")
                need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the archive ends within a record")


def inflated(f) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or of many, in pieces of bounded size."""
    engine = zlib.decompressobj(31)
    while data := f.read(CHUNK):
        while data:
            yield engine.decompress(data, CHUNK)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, CHUNK)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
            else:
                break


def store(folder: str):
    """The file system and path of a folder, for Python on any machine."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
    system.create_dir(path, recursive=True)
    return system, path


def write_monolithic(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write rows (page_id, url, html, digest, refers_to, revisit) as gzip files of one member each: file, records, bytes.

    Every attempt of a task writes files of new names; only those in the returned rows count, so a lost executor or a
    repeated task leaves nothing wrong behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        done, out, engine, n, size, name = [], None, None, 0, 0, ""

        def close():
            out.write(engine.flush())
            out.close()
            done.append((name, n, size))

        for batch in (whole.slice(i, 100) for whole in batches for i in range(0, whole.num_rows, 100)):
            for row in batch.to_pylist():
                if out is None:
                    name, engine, n, size = f"{uuid.uuid4().hex}.raw.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                out.write(engine.compress(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["revisit"])))
                n, size = n + 1, size + len(payload)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return pages.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(run, "file string, records long, bytes long")


def normalise(files: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite each archive of ``source`` with one gzip member per record, and write its index beside it: file, index, records.

    A file is inflated once, in pieces, and one record is held at a time. The index has a JSON line per record with its
    offset and length in the new file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, path), (_, raw) = store(folder), store(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with system.open_input_stream(f"{raw}/{name}", compression=None) as f, system.open_output_stream(f"{path}/{new}", compression=None) as out, system.open_output_stream(f"{path}/{new}.idx", compression=None) as index:
                    for whole in records(inflated(f)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(whole) + engine.flush()
                        head = parse_head(whole[: whole.find(b"\r\n\r\n")])
                        out.write(member)
                        index.write(json.dumps({"id": head["warc-record-id"], "type": head["warc-type"], "digest": head["warc-payload-digest"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([f"{new}.idx"]), pa.array([n], pa.int64())], ["file", "index", "records"])

    return files.select("file").mapInArrow(run, "file string, index string, records long")


def read_archives(files: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """Read records by their index entries and check what they hold: one row per record.

    Each member is inflated by itself at its offset; a response's size and digest are taken from its payload, a
    revisit's from its headers.
    """
    number = kind in ("bigint", "int", "smallint", "tinyint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        system, path = store(folder)
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length")
        types = (pa.int64() if number else pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64() if number else pa.string(), pa.string(), pa.int64(), pa.int64())
        key = lambda name: int(x) if (x := named(name)) is not None and number else x
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], list(names))
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                with system.open_input_stream(f"{path}/{row['index']}", compression=None) as lines, system.open_input_file(f"{path}/{row['file']}") as f:
                    rest = b""
                    while (data := lines.read(CHUNK)) or rest:
                        *whole, rest = (rest + data).split(b"\n") if data else (rest, b"")
                        for line in filter(None, whole):
                            entry = json.loads(line)
                            f.seek(entry["offset"])
                            member = zlib.decompress(f.read(entry["length"]), 31)
                            head, _, block = member.partition(b"\r\n\r\n")
                            head = parse_head(head)
                            response = head["warc-type"] == "response"
                            payload = block[: int(head["content-length"])].partition(b"\r\n\r\n")[2]
                            size, digest = (len(payload), hashlib.sha256(payload).hexdigest()) if response else (int(head["warc-payload-length"]), head["warc-payload-digest"][7:])
                            if f"sha256:{digest}" != entry["digest"] or head["warc-record-id"] != entry["id"]:
                                raise ValueError(f"{row['file']}: the index and the record at {entry['offset']} differ")
                            out.append((key(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], key(head.get("warc-refers-to")), row["file"], entry["offset"], entry["length"]))
                        if len(out) >= 5000:
                            yield batch_of(out)
                            out = []
                yield batch_of(out)

    shown = "bigint" if number else "string"
    return files.select("file", "index").mapInArrow(run, f"page_id {shown}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {shown}, file string, offset long, length long")


def plan_records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """The rows of ``pages`` with digest, whether they revisit another, and which.

    Of records with equal payloads of at least ``least_shared`` bytes, those with the smallest page_id are responses.
    Minima are combined before the shuffle; then small rows without the html join on the digest, where AQE splits
    a frequent one, and the html moves once, by page_id.
    """
    sized = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    firsts = sized.where(F.col("size") >= least_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first")
    keys = sized.select("page_id", "digest").distinct()
    revisits = keys.join(firsts, F.col("digest") == F.col("_digest")).where("NOT page_id <=> first").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    joined = sized.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_shared: int = LEAST_SHARED, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each page, normalise the archives, and read them back from the offset index.

    Null html is an empty payload; null urls have no target; rows repeated with their page_id are records each (equal
    ones are responses all, as none has a smaller id); a null page_id refers to no smaller one. No rows give no files.
    The archives lie in ``folder``; by default in the shared one, until the driver's process ends. The monolithic ones
    are removed when they have been rewritten.
    """
    spark = common.ready(pages.sparkSession)
    if not folder:
        folder = f"{common.shared_folder(spark)}/tidemark-warc-{uuid.uuid4().hex}"
        atexit.register(common.remove, spark, folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    raw = common.settle(write_monolithic(plan_records(pages, least_shared), f"{folder}/raw", roll_bytes), "warc-raw")
    n = max(1, min(raw.count(), 10_000))
    done = common.settle(normalise(raw.repartition(n), f"{folder}/raw", folder), "warc-files")
    common.remove(spark, f"{folder}/raw")
    common.discard(raw)
    common.freed(spark)
    return read_archives(done.repartition(n), folder, kind)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    read = archive_round_trip(common.table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
