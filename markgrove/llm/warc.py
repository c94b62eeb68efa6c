"""WARC archives: a deterministic sharded writer, and a reader that trusts only committed manifests.

Records are placed by payload digest: a shard is a range of digests, so equal
payloads meet in one sorted run, whose first record (largest page id) is the
response and whose others revisit it. Digests are uniform, so shards are even
without sampling. Payloads that would make a run long (more than HOT_SHARE of all
records, at most 1/HOT_SHARE of them) or that never need a run (shorter than
REVISIT_BYTES) are placed by a hash of the page id instead; the response of a hot
payload comes from a broadcast of that bounded list. The page text moves once.

A task writes its records, each a gzip member, in order of place, digest and
descending page id; it rolls to a new file when the compressed size reaches the
limit. Files get temporary names and are renamed when complete; names and bytes
depend on the records only, so a repeated attempt replaces a file by itself.
The manifest, written last by Spark's committer, lists files, sizes and counts;
readers open nothing that it does not list. Headers and digests are made anew
from the payload, never taken from the input.

Defined results: a null html is an empty payload; a null url becomes a urn; rows
that repeat a page id with the same payload share its record type; rows without a
page id never serve as a response that others refer to while one with an id
exists; an empty table gives an empty manifest and no rows; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal payloads shorter than this are stored each time.
REVISIT_BYTES = 1000
#: A payload with more than this share of all records, and than HOT_ROWS of them, is hot.
HOT_SHARE, HOT_ROWS = 1e-5, 1000
#: Payload bytes a shard, about, and compressed bytes at which a file is rolled.
SHARD_BYTES, ROLL_BYTES = 48 << 20, 64 << 20
LEVEL = 4
#: The date in every record: records are functions of the input, not of the clock.
WARC_DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PLACES = 60


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def _clean(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; with ``refers_to`` a revisit, which holds the HTTP head alone."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    b32 = lambda d: base64.b32encode(d).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest.hex())}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_clean(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{b32(digest)}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    lines += [f"WARC-X-Page-ID: {page_id}"] if page_id is not None else []
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest.hex())}",
            f"WARC-X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shards:
    """The files that one task writes."""

    def __init__(self, uri: str, roll: int):
        self.fs, self.base = _filesystem(uri)
        self.roll, self.shard, self.part, self.out = roll, None, 0, None
        self.done: list[tuple[str, int, int]] = []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.part:04d}.warc.gz"
        self.temporary = f"{self.base}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
        self.out, self.size, self.records = self.fs.open_output_stream(self.temporary), 0, 0

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        final = f"{self.base}/{self.name}"
        written = self.fs.get_file_info(self.temporary).size
        if written != self.size:
            raise OSError(f"{self.temporary} has {written} bytes, not {self.size}")
        try:
            self.fs.move(self.temporary, final)
        except OSError:
            if not self.fs.get_file_info(final).is_file:
                raise
            # an earlier attempt left the same bytes under this name
            self.fs.delete_file(final)
            self.fs.move(self.temporary, final)
        self.done.append((self.name, self.size, self.records))

    def write(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        elif self.out is not None and self.size >= self.roll:
            self.close()
            self.part += 1
        if self.out is None:
            self._open()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.size += len(member)
        self.records += 1


def write_warc(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", html: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every row of ``pages`` to archives below ``uri``; returns the committed manifest (file, bytes, records)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.col(url).alias("_url"), payload.alias("_html"))
    rows = rows.withColumns({"_n": F.octet_length("_html").cast("long"), "_digest": F.sha1("_html")})
    groups = rows.groupBy("_digest", "_n").agg(F.count("*").alias("_rows"), F.max("_id").alias("_last"))
    total, size = groups.agg(F.sum("_rows"), F.sum(F.col("_rows") * F.col("_n"))).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    least = max(HOT_ROWS, int((total or 0) * HOT_SHARE))
    hot = groups.where((F.col("_rows") > least) & (F.col("_n") >= REVISIT_BYTES)).select(F.col("_digest").alias("_hot"), "_last")
    placed = rows.join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left")
    by_digest = F.conv(F.substring("_digest", 1, _PLACES // 4), 16, 10).cast("long")
    by_id = F.xxhash64("_id", "_url").bitwiseAND(F.lit(2**_PLACES - 1))
    place = F.when(F.col("_hot").isNotNull() | (F.col("_n") < REVISIT_BYTES), by_id).otherwise(by_digest)
    placed = placed.withColumn("_place", place)
    # shard = place * shards / 2**60, in integers that cannot overflow
    placed = placed.withColumn("_shard", F.shiftright(F.shiftright("_place", 30) * F.lit(shards), 30).cast("int"))
    placed = placed.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_place", "_digest", F.desc_nulls_last("_id"), "_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Shards(uri, roll_bytes)
        run, first = None, None
        for batch in batches:
            for shard, page_id, address, text, n, digest, is_hot, last in zip(*(c for c in batch.columns), strict=True):
                n, page_id = n.as_py(), page_id.as_py()
                refers_to = None
                if n >= REVISIT_BYTES:
                    if is_hot.as_py() is not None:
                        first = last.as_py()
                    elif digest.as_py() != run:
                        run, first = digest.as_py(), page_id
                    refers_to = first if page_id != first else None
                files.write(shard.as_py(), make_record(page_id, address.as_py(), text.as_py().encode(), refers_to))
        files.close()
        names, sizes, counts = zip(*files.done, strict=True) if files.done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["file", "bytes", "records"])

    columns = ("_shard", "_id", "_url", "_html", "_n", "_digest", "_hot", "_last")
    placed.select(*columns).mapInArrow(write, "file string, bytes long, records long").write.mode("overwrite").parquet(f"{uri}/_manifest")
    return spark.read.schema("file string, bytes long, records long").parquet(f"{uri}/_manifest")


def parse_members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed records of an archive, one gzip member at a time."""
    rest = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if parts:
                    raise EOFError("an archive ends inside a record")
                return
            parts.append(member.decompress(rest))
            rest = member.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> dict[str, object]:
    """The fields of a record, with digests checked against its content."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record has the wrong length")
    digest_of = lambda name: base64.b32decode(fields[name].removeprefix("sha1:")).hex()
    if hashlib.sha1(block).hexdigest() != digest_of("WARC-Block-Digest"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = digest_of("WARC-Payload-Digest")
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, length):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("WARC-X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": number("WARC-X-Refers-To-Page-ID"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read_warc(spark: SparkSession, uri: str, payload: bool = False) -> DataFrame:
    """One row per record of the committed archives below ``uri``; ``payload`` adds the stored bytes (null for revisits)."""
    manifest = spark.read.schema("file string, bytes long, records long").parquet(f"{uri}/_manifest").select("file", "records")
    files = manifest.count()
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64())] + ([("payload", pa.binary())] if payload else [])
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(uri)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in parse_members(stream):
                        rows.append(parse_record(record))
                        held, seen = held + len(record), seen + 1
                        if held > 16 << 20 or len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    return manifest.repartition(max(1, min(files, 10_000))).mapInArrow(read, ddl)
