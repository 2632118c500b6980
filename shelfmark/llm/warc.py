"""WARC archives: a writer of one gzip member per record and a sequential reader.

The reader takes any archive with one member per record: it inflates incrementally, frames records by Content-Length and
checks the SHA-1 digests that are there.  Records of every type are returned; payloads are those of responses (chunked
transfer coding undone), resources and conversions.  Between writer and reader an archive travels as the bytes of one
file, cut into volumes of bounded size, so any store Spark writes to can hold it; `write_files` makes .warc.gz files of them.

Defined cases: a null payload is an empty one; a null url is written as `about:blank`; rows that repeat an id and a
payload are all responses if that id is the smallest of its payload; an empty table gives no volumes and no records;
further columns are ignored.  What a record has no header for is null.  A damaged record raises ValueError and names the
archive and offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .buffers import slices
from .store import materialise

VOLUME_BYTES = 2 << 20
#: The date all records carry: results must not depend on the clock.
WRITTEN = "2024-01-01T00:00:00Z"
VOLUMES = "archive string, records long, content binary"
RECORDS = "archive string, offset long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {WRITTEN}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        *([] if page_id is None else [f"WARC-Page-ID: {page_id}"]),
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def pack_volumes(level: int, volume_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From page_id, url, payload, digest (hex), refers_to to VOLUMES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, volume = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{volume:05d}.warc.gz"], "records": [len(held)], "content": [b"".join(held)]})

        for batch in batches:
            for rows in slices(batch, "payload"):
                for page_id, url, payload, digest, refers_to in zip(*(rows.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    clean = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
                    held.append(_record(page_id, clean, payload or b"", base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, level))
                    size += len(held[-1])
                    if size >= volume_bytes:
                        yield flush()
                        held, size, volume = [], 0, volume + 1
        if held:
            yield flush()

    return run


def members(chunks: Iterable[bytes | memoryview]) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member of a stream that comes in chunks of any size."""
    z, start, at, out = None, 0, 0, []
    for chunk in chunks:
        rest = bytes(chunk)
        while rest:
            if z is None:
                z, start, out = zlib.decompressobj(31), at, []
            try:
                out.append(z.decompress(rest))
            except zlib.error as e:
                raise ValueError(f"no gzip member at {start}: {e}") from e
            at += len(rest) - len(z.unused_data)
            rest = z.unused_data
            if z.eof:
                yield start, b"".join(out)
                z = None
    if z is not None:
        raise ValueError(f"the gzip member at {start} is cut off")


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:  # a folded line
            out[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; a body that is not so coded is returned as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _sha1(warc: dict[str, str], header: str) -> str | None:
    kind, _, digest = warc.get(header, "").partition(":")
    return digest.upper() if kind.lower() == "sha1" and digest else None


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdigit() else None


def parse_record(where: str, data: bytes) -> tuple:
    """One record, from its inflated member: RECORDS without archive and offset."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, _, fields = head.partition(b"\r\n")
    if not mark or not first.startswith(b"WARC/"):
        raise ValueError(f"{where}: not a WARC record")
    warc = _headers(fields)
    n = _number(warc.get("content-length"))
    if n is None or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{where}: Content-Length {n} does not frame the block")
    block, kind = rest[:n], warc.get("warc-type", "")
    if (digest := _sha1(warc, "warc-block-digest")) and digest != base32_sha1(block):
        raise ValueError(f"{where}: block digest differs")
    payload, size, digest = None, None, _sha1(warc, "warc-payload-digest")
    if kind in ("response", "revisit") and warc.get("content-type", "").lower().startswith("application/http"):
        status, mark, body = block.partition(b"\r\n\r\n")
        http = _headers(status.partition(b"\r\n")[2])
        size = _number(http.get("content-length"))
        if kind == "response":
            payload = unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
            whole = "warc-truncated" not in warc
            if whole and digest and digest not in (base32_sha1(payload), base32_sha1(body)):
                raise ValueError(f"{where}: payload digest differs")
            if whole and not digest and payload is body and size not in (None, len(body)):
                raise ValueError(f"{where}: the payload has {len(body)} bytes, not {size}")
    elif kind in ("response", "resource", "conversion"):
        payload = block
        if digest and digest != base32_sha1(block):
            raise ValueError(f"{where}: payload digest differs")
    if payload is not None:
        size, digest = len(payload), digest or base32_sha1(payload)
    uri = warc.get("warc-target-uri")
    ids = [_number(warc.get(k)) for k in ("warc-page-id", "warc-refers-to-page-id")]
    return kind, warc.get("warc-record-id", "").strip("<>"), uri and uri.strip("<>"), ids[0], ids[1], size, digest, payload


def parse(archive: str, chunks: Iterable[bytes | memoryview]) -> Iterator[tuple]:
    """Records of one archive in RECORDS order."""
    try:
        for offset, data in members(chunks):
            yield (archive, offset, *parse_record(f"record at {offset}", data))
    except ValueError as e:
        raise ValueError(f"{archive}: {e}") from e


def _pieces(content: memoryview, step: int = 1 << 14) -> Iterator[memoryview]:
    for at in range(0, len(content), step):
        yield content[at : at + step]


def _stream(path: str, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a file that any executor can open by its path."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))  # Spark names local files with one slash
    with store.open_input_stream(name, compression=None) as f:
        while piece := f.read(step):
            yield piece


def read_volumes(with_payload: bool, batch_rows: int = 256, batch_bytes: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From archive and content, or archive alone where that is a path to stream from, to RECORDS."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [tuple(x.split()) for x in RECORDS.split(", ")]
    schema = pa.schema([(name, types[kind]) for name, kind in fields if with_payload or name != "payload"])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("archive").to_pylist()
            contents = batch.column("content") if "content" in batch.schema.names else [None] * len(names)
            for archive, content in zip(names, contents, strict=True):
                held: list[tuple] = []
                size = 0
                for row in parse(archive, _stream(archive) if content is None else _pieces(memoryview(content.as_buffer()))):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) == batch_rows or size >= batch_bytes:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return run


def revisit_plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to): the smallest page_id of equal payloads of least_bytes or more is the response."""
    keys = pages.select("page_id", F.sha1("payload").alias("digest"), (F.length("payload") >= least_bytes).alias("counts")).distinct()
    first = keys.filter("counts").groupBy("digest").agg(F.min("page_id").alias("first"))
    return keys.join(first, "digest", "left").select(
        "page_id", "digest", F.when(F.col("counts") & (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, least_bytes: int = 0, level: int = 1, volume_bytes: int = VOLUME_BYTES) -> DataFrame:
    """pages: page_id long, url string, payload binary.  Returns the written VOLUMES.

    Payloads move once, dealt by page_id, so a payload that a third of the pages share does not meet in one task.
    """
    plan = revisit_plan(pages, least_bytes).alias("plan")
    rows = pages.withColumn("sha", F.sha1("payload")).alias("rows")
    dealt = rows.join(plan, F.col("rows.page_id").eqNullSafe(F.col("plan.page_id")) & (F.col("rows.sha") == F.col("plan.digest")))
    dealt = dealt.select("rows.page_id", "rows.url", "rows.payload", "plan.digest", "plan.refers_to")
    return materialise(dealt.mapInArrow(pack_volumes(level, volume_bytes), VOLUMES), "warc")


def read_archives(volumes: DataFrame, with_payload: bool = True) -> DataFrame:
    """RECORDS of VOLUMES, or of any table with archive and content (see read_files)."""
    schema = RECORDS if with_payload else RECORDS.rpartition(", ")[0]
    return volumes.select("archive", "content").mapInArrow(read_volumes(with_payload), schema)


def write_files(volumes: DataFrame, folder: str) -> DataFrame:
    """(path, records) of the .warc.gz files written into folder, a URI that executors can write to, one for each volume.

    A task that runs again writes the same bytes under the same name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names = batch.column("archive").to_pylist()
            for name, content in zip(names, batch.column("content"), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{n}" for n in names], pa.string()), batch.column("records")], ["path", "records"])

    return materialise(volumes.select("archive", "content", "records").mapInArrow(run, "path string, records long"), "warc-files")


def read_files(spark: SparkSession, path: str, with_payload: bool = True, through_spark: bool = False) -> DataFrame:
    """RECORDS of .warc.gz files, one task for each file or more.

    Files are streamed, so they may be of any size.  Where their store is one that only Spark's readers know,
    through_spark reads each file whole instead (2 GB at most).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    if through_spark:
        return read_archives(files.select(F.col("path").alias("archive"), "content"), with_payload)
    names = files.select(F.col("path").alias("archive"))  # contents are not read for this
    schema = RECORDS if with_payload else RECORDS.rpartition(", ")[0]
    return names.mapInArrow(read_volumes(with_payload), schema)
