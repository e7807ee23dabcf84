"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by id and digest. The bounds of the shards are byte quantiles of the keys of least
hash, so they follow any distribution of ids and are the same for the same table; every record is written
as one gzip member. A shard is a stream: its size bounds no memory.
A file is rolled at a compressed size, written under a temporary name and renamed; a shard that runs
twice writes the same bytes. A manifest in the archive's folder, renamed into place last, lists the files
that make it up; only these are read, and each must have the listed digest and number of records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.common import tidied
from docforge.plans.tables import bounded_arrow, new_path, release, written

#: Uncompressed bytes of a shard, most shards (beyond, they get larger), and compressed bytes at which a file is rolled.
SHARD_BYTES, MAX_SHARDS = 24 << 20, 1 << 15
ROLL_BYTES = 8 << 20
#: Keys that the shards' bounds are taken from, about; the bytes that a record counts besides its payload; shards that get a partition each.
BOUND_KEYS, RECORD_BYTES, SLOTS = 1 << 18, 512, 1024
MANIFEST = "manifest.jsonl"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, headers and digests generated; a revisit keeps the HTTP headers and no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_uri(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_uri(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _duplicates(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Digests and sizes of all payloads, and (page_id, digest, first_id) of those that revisit an earlier one."""
    light = written(pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("long").alias("n")), "digests")
    sized = light.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    first = sized.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sha1", "first_id")
    return light, sized.select("page_id", "sha1").distinct().join(first, "sha1").where("page_id > first_id")


def _key(page_id: Column, sha1: Column) -> Column:
    """Ids and digests as text that sorts in their order, rows without an id first."""
    return F.concat(F.when(page_id.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))), F.substring(sha1, 1, 8))


def _bounds(light: DataFrame, shard_bytes: int) -> list[str]:
    """The least keys of all shards but the first."""
    rows, total = light.agg(F.count(F.lit(1)), F.sum(F.col("n") + RECORD_BYTES)).first()
    shards = min(MAX_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return []
    share = int(min(1.0, BOUND_KEYS / rows) * (1 << 32))
    some = light.where(F.pmod(F.xxhash64("page_id", "sha1"), F.lit(1 << 32)) < share)
    keys = some.groupBy(_key(F.col("page_id"), F.col("sha1")).alias("key")).agg(F.sum(F.col("n") + RECORD_BYTES).alias("n")).toArrow().sort_by("key")
    if not keys.num_rows:
        return []
    before = np.cumsum(keys.column("n").to_numpy()) - keys.column("n").to_numpy()
    own = before * shards // max(1, int(keys.column("n").to_numpy().sum()))
    return [keys.column("key")[int(i)].as_py() for i in np.flatnonzero(own[1:] != own[:-1]) + 1]


def _shard(key: Column, bounds: list[str]) -> Column:
    """The number of bounds up to a key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    listed, n = F.split(F.lit(",".join(bounds)), ","), len(bounds)
    steps = F.array(*(F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(listed, low + step - 1) <= key), low + step).otherwise(low))


def _writer(root: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        rows: list[dict] = []
        part: list[bytes] = []
        size, shard, seq, n = 0, None, 0, 0

        def roll() -> None:
            nonlocal part, size, seq, n
            if not n:
                return
            name = f"part-{shard:06d}-{seq:04d}.warc.gz"
            info = f"software: docforge\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
            head = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_uri(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))])
            data = member(head + info + b"\r\n\r\n") + b"".join(part)
            temporary = f"{base}/_temporary-{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(data)
            try:
                store.move(temporary, f"{base}/{name}")
            except OSError:  # the other run of this shard may have come first, with the same bytes
                if store.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    raise
                with store.open_input_stream(f"{base}/{name}", compression=None) as held:
                    if hashlib.sha256(held.read()).digest() != hashlib.sha256(data).digest():
                        raise
                store.delete_file(temporary)
            rows.append({"file": name, "n_records": n, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            part, size, n = [], 0, 0
            seq += 1

        current: tuple | None = None
        firsts: dict[str, int] = {}
        for batch in batches:
            col = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(len(batch)):
                own, page_id, kind, url, sha1, first = (col[j][i].as_py() for j in (0, 1, 2, 3, 5, 6))
                if own != shard:
                    roll()
                    shard, seq = own, 0
                if page_id != current:
                    current, firsts = page_id, {}
                if kind == 0:
                    firsts[sha1] = first
                    continue
                payload = col[4][i].as_buffer().to_pybytes()
                refers = firsts.get(hashlib.sha1(payload).hexdigest()) if firsts else None
                part.append(member(record(page_id, url, payload, refers, date)))
                size, n = size + len(part[-1]), n + 1
                if size >= roll_bytes:
                    roll()
        roll()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def write_warc(pages: DataFrame, root: str | None = None, *, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = "2026-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write one record per row into ``root`` (a folder that all executors share); returns it and the manifest.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least
    ``least_bytes`` bytes, those with the smallest page_id are response records and the others revisit
    it; the rest are all response records. A row without page_id is a response that nothing refers to;
    rows that repeat the smallest page_id are each a response; a null url is written as urn:page:<id>.
    Other columns are ignored. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    bounded_arrow(spark)
    root = root or new_path(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    light, revisits = _duplicates(rows, least_bytes)
    bounds = _bounds(light, shard_bytes)
    shard = lambda sha1: _shard(_key(F.col("page_id"), sha1), bounds).alias("shard")
    html = rows.select(shard(F.sha1(F.col("html").cast("binary"))), "page_id", F.lit(1).alias("kind"), "url", F.col("html").cast("binary").alias("html"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("first_id"))
    marks = revisits.select(shard(F.col("sha1")), "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "sha1", "first_id")
    shards = len(bounds) + 1
    by = slot(spark, shards) if shards <= SLOTS else F.col("shard")
    dealt = html.unionByName(marks).repartition(shards, by).sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.delete(_path(spark, root, MANIFEST), False)  # until the new one is in place there is no archive
    manifest = written(dealt.mapInArrow(tidied(_writer(root, roll_bytes, date)), "file string, n_records bigint, n_bytes bigint, sha256 string"), "manifest")
    _commit(spark, root, manifest)
    release(light)
    return root, manifest


def _path(spark: SparkSession, root: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")


def _commit(spark: SparkSession, root: str, manifest: DataFrame) -> None:
    """The manifest into the archive's folder, by a temporary name."""
    lines = "".join(json.dumps(r.asDict()) + "\n" for r in manifest.orderBy("file").collect())
    temporary, target = _path(spark, root, f"_temporary-{MANIFEST}-{uuid.uuid4().hex}"), _path(spark, root, MANIFEST)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(temporary, True)
    out.write(bytearray(lines.encode()))
    out.close()
    if not files.rename(temporary, target):
        raise OSError(f"the manifest of {root} could not be renamed")


def manifest_of(spark: SparkSession, root: str) -> dict[str, dict]:
    """The files of an archive by name, as its manifest lists them; an error if the folder has none."""
    target = _path(spark, root, MANIFEST)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(target):
        raise FileNotFoundError(f"{root} has no {MANIFEST}: its archive was not finished")
    stream = files.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {r["file"]: r for r in map(json.loads, text.splitlines())}


def slot(spark: SparkSession, n: int):
    """A key for each of n shards that hash partitioning over n partitions deals to a partition of its own."""
    keys = spark.range(n * 16 + 64).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    own = {r.p: r.id for r in keys}
    return F.coalesce(F.expr(f"get(array({','.join(str(own.get(i, i)) for i in range(n))}), shard)"), F.lit(0))


def members(data: bytes) -> Iterator[bytes]:
    """Uncompressed gzip members."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            step = view[at : at + (1 << 16)]
            if not len(step):
                raise ValueError("an archive ends inside a record")
            out.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def _reader(batches: Iterator[pa.RecordBatch], listed: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for i in range(len(batch)):
            file = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
            rows, held, n = [], 0, 0
            content = batch.column(1)[i].as_buffer().to_pybytes()
            if hashlib.sha256(content).hexdigest() != listed[file]["sha256"]:
                raise ValueError(f"{file} does not have the digest that the manifest lists")
            for data in members(content):
                fields, block = parsed(data)
                if fields["warc-type"] == "warcinfo":
                    continue
                if f"sha1:{base32_sha1(block)}" != fields["warc-block-digest"]:
                    raise ValueError(f"{file}: the block of {fields['warc-record-id']} does not have its digest")
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{file}: the payload of {fields['warc-record-id']} does not have its digest")
                number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
                rows.append({"file": file, "page_id": number("x-page-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "payload": payload if fields["warc-type"] == "response" else None})
                held, n = held + len(payload), n + 1
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if n != listed[file]["n_records"]:
                raise ValueError(f"{file} has {n} records, the manifest lists {listed[file]['n_records']}")
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _facts(batches: Iterator[pa.RecordBatch], listed: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in _reader(batches, listed):
        yield batch.select([n for n in batch.schema.names if n != "payload"])


def read_warc(spark: SparkSession, root: str, *, payloads: bool = True) -> DataFrame:
    """The records of an archive: file, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Exactly the files of the manifest are read; one that is missing, or has another digest or number of
    records, fails the read. Digests of blocks and payloads are recomputed; a record that differs from its
    own fails the read. A revisit has no payload. An archive without files has no rows.
    """
    bounded_arrow(spark)
    schema = "file string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * payloads
    listed = manifest_of(spark, root)
    if not listed:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(listed)
    files = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{name}" for name in sorted(listed)]).select("path", "content")
    read = _reader if payloads else _facts
    return files.mapInArrow(tidied(lambda batches: read(batches, held.value)), schema)
