"""WARC archives: whole-file gzip streams are inflated once and rewritten with a gzip member per record and an offset index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_hot, stored, texts_of

READ_BYTES, LEVEL, RECORD_END = 1 << 20, 3, b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)")
#: Bytes of archives that one reading task is given.
TASK_BYTES = 16 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value) -> str:
    """One line, whatever the value holds."""
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in str(value))


def header_text(value: str) -> str:
    for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
        value = value.replace(code, c)
    return value


def record_name(page_id, url: str | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}{chr(10)}{url}{chr(10)}{payload_digest}')}>"


def record_of(page_id, url: str | None, html: str | None, first: tuple | None = None, date: str = DATE) -> str:
    """A record without its closing line ends; a null id or url has no header, a null payload is an empty one.

    With ``first``, the (id, url) of the page that has the same payload, it is a revisit of that page's response, without payload.
    """
    payload = html or ""
    raw = payload.encode("utf-8", "replace")
    http, name = HTTP.format(len(raw)), digest(raw)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {record_name(page_id, url, name)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {header_value(page_id)}")
    if first:
        head += [PROFILE, f"WARC-Refers-To: {record_name(*first, name)}", f"WARC-Refers-To-Page-ID: {header_value(first[0])}"]
    block = http if first else http + payload
    size = len(http) if first else len(http) + len(raw)
    head += [f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def first_pages(pages: DataFrame, at_least: int) -> DataFrame:
    """_llm_digest, _llm_n and _llm_first (id, url) of the payloads that several pages have; written, so that Spark knows their size."""
    long = pages.filter(F.octet_length("_llm_html") >= at_least)
    groups = long.groupBy("_llm_digest").agg(F.count("*").alias("_llm_n"), F.min(F.when(F.col("_llm_id").isNotNull(), F.struct("_llm_id", "_llm_url"))).alias("_llm_first"))
    return stored(groups.filter("_llm_n > 1 and _llm_first is not null"))


def write_streams(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at_least: int = 0) -> None:
    """One record per row; Spark's text writer makes each partition one gzip stream over all of its records.

    Of equal payloads of ``at_least`` bytes, that with the smallest id is a response and the others are revisit records, as
    ``mark_revisits`` says. Repeated rows are a record each; an empty table gives streams without records. Payloads are
    compared by digest; they are shuffled only if the groups of equal ones are too many for Spark to broadcast.
    """
    kept = pages.select(F.col(id_col).alias("_llm_id"), F.col(url_col).alias("_llm_url"), F.coalesce(F.col(payload_col), F.lit("")).alias("_llm_html"))
    kept = kept.withColumn("_llm_digest", F.sha1("_llm_html"))
    met = join_hot(kept, first_pages(kept, at_least), "_llm_digest", "_llm_n", pages.count())
    other = (F.octet_length("_llm_html") >= at_least) & F.col("_llm_first").isNotNull() & ~F.col("_llm_id").eqNullSafe(F.col("_llm_first._llm_id"))
    marked = met.select("_llm_id", "_llm_url", "_llm_html", F.when(other, F.col("_llm_first._llm_id")).alias("first_id"), F.when(other, F.col("_llm_first._llm_url")).alias("first_url"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(texts_of(batch, name) for name in ("_llm_id", "_llm_url", "_llm_html", "first_id", "first_url")))
            made = [record_of(page_id, url, html, None if first is None else (first, first_url)) for page_id, url, html, first, first_url in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    marked.mapInArrow(records, "value string").write.option("compression", "gzip").option("lineSep", RECORD_END.decode()).text(path)


def inflated(stream) -> Iterator[bytes]:
    """Pieces of the content of one or more gzip members."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            yield unpack.decompress(data, READ_BYTES)
            while unpack.unconsumed_tail:
                yield unpack.decompress(unpack.unconsumed_tail, READ_BYTES)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            else:
                break
    rest = unpack.flush()
    if rest:
        yield rest


def records_in(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, their closing line ends included; only one is held at a time. A record cut short is an error."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(RECORD_END)
                if end < 0:
                    break
                need = end + 4 + length_of(bytes(held[:end])) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError(f"the archive ends within a record, {len(held)} bytes after its start")


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].lstrip("\r\n").startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def length_of(head: bytes) -> int:
    return int(headers_of(head)["content-length"])


INDEX = "path string, offset long, length long, record_id string, page_id string, url string, warc_type string"


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Every archive below ``source`` anew below ``target``: each record its own gzip member. Returns the offset index.

    Each task inflates its files once, as streams, holding one record at a time. Repeated rows stay records of their own, and
    streams without records give archives without members. Beside each new archive lies its sidecar
    index (``.cdxj``: offset, length, id, url a line); the table returned holds the same for all. A task that runs again writes
    the same bytes: results take their names only when they are complete.
    """
    from pyarrow import fs

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(source).select("path", F.col("length").alias("bytes"))
    found = files.count()
    spread = files.repartition(max(1, found), F.xxhash64("path")) if found > 1 else files

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        where, root = fs.FileSystem.from_uri(target)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for path in texts_of(batch, "path"):
                source_fs, source_path = fs.FileSystem.from_uri(path)
                name = f"{root}/{source_path.rsplit('/', 1)[-1].split('.')[0]}-{zlib.crc32(source_path.encode()):08x}.warc.gz"
                draft = f"{root}/_draft-{uuid.uuid4().hex}"
                rows, lines, at = [], [], 0
                with source_fs.open_input_stream(source_path, compression=None) as stream, where.open_output_stream(draft, compression=None) as out:
                    for record in records_in(inflated(stream)):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(record) + pack.flush()
                        out.write(member)
                        head = headers_of(record[: record.find(RECORD_END)])
                        url = head.get("warc-target-uri")
                        row = (name, at, len(member), head.get("warc-record-id"), head.get("warc-page-id"), None if url is None else header_text(url), head.get("warc-type"))
                        rows.append(row)
                        lines.append(json.dumps({"offset": at, "length": len(member), "id": row[3], "url": row[5]}))
                        at += len(member)
                with where.open_output_stream(f"{draft}.cdxj", compression=None) as out:
                    out.write("".join(line + "\n" for line in lines).encode())
                for made, final in ((f"{draft}.cdxj", f"{name}.cdxj"), (draft, name)):
                    if where.get_file_info(final).type != fs.FileType.NotFound:
                        where.delete_file(final)
                    where.move(made, final)
                for k in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[k : k + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (1, 2) else pa.string()) for i, c in enumerate(columns)], names=["path", "offset", "length", "record_id", "page_id", "url", "warc_type"])

    index = stored(spread.select("path").mapInArrow(rewrite, INDEX))
    return index.withColumn("path", F.concat(F.lit(scheme_of(target)), "path"))


def scheme_of(uri: str) -> str:
    """What stands before the path that a file system names its files by."""
    from pyarrow import fs

    return uri[: uri.index(fs.FileSystem.from_uri(uri)[1])]


def read_members(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records by their offsets: page_id (as text), url, payload_bytes, payload_digest, record_type, refers_to and, if asked, the payload.

    A revisit has the size and digest of the payload it stands for, the page id (as text) of the response that holds it, and
    no payload. Each task opens an archive once and reads its members in their order; a payload that doesn't match its record's
    digest is an error.
    """
    from pyarrow import fs

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    spread = index.select("path", "offset", "length").repartition(int(parts), "path", F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for here, offset, length in zip(texts_of(batch, "path"), texts_of(batch, "offset"), texts_of(batch, "length")):
                if here != path:
                    if file:
                        file.close()
                    where, inside = fs.FileSystem.from_uri(here)
                    path, file = here, where.open_input_file(inside)
                record = zlib.decompress(file.read_at(length, offset), 31)
                end = record.find(RECORD_END)
                head = headers_of(record[:end])
                block = record[end + 4 : end + 4 + int(head["content-length"])]
                again = head.get("warc-type") == "revisit"
                if again:
                    payload, name = None, head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(HTTP_LENGTH.search(block)[1])
                else:
                    payload = block[block.find(RECORD_END) + 4 :] if head.get("content-type", "").startswith("application/http") else block
                    name, size = digest(payload), len(payload)
                if head.get("warc-payload-digest", f"sha1:{name}") != f"sha1:{name}":
                    raise ValueError(f"{here} at {offset}: the payload doesn't match its digest")
                page, url, first = (None if v is None else header_text(v) for v in (head.get(h) for h in ("warc-page-id", "warc-target-uri", "warc-refers-to-page-id")))
                rows.append((page, url, size, name, "revisit" if again else "response", first if again else None, payload if with_payload else None))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            keep = 7 if with_payload else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:keep], kinds)], names=names[:keep])
        if file:
            file.close()

    return spread.mapInArrow(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)


def mark_revisits(records: DataFrame, id_col: str = "page_id", at_least: int | Column = 0) -> DataFrame:
    """``records`` with record_type and refers_to, as their digests say: of equal payloads the one with the smallest id is the response.

    The others revisit it; payloads under ``at_least`` bytes are all responses. A null id is never the smallest;
    payloads that only records without id have, and further rows with the smallest id itself, are responses.
    """
    records = records.drop("record_type", "refers_to")
    long = records.filter(F.col("payload_bytes") >= at_least)
    groups = long.groupBy("payload_digest").agg(F.count("*").alias("_llm_n"), F.min(id_col).alias("_llm_first")).filter("_llm_n > 1")
    met = join_hot(records, groups, "payload_digest", "_llm_n", records.count())
    other = (F.col("payload_bytes") >= at_least) & F.col("_llm_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_llm_first"))
    return met.withColumn("record_type", F.when(other, "revisit").otherwise("response")).withColumn("refers_to", F.when(other, F.col("_llm_first"))).drop("_llm_first")
