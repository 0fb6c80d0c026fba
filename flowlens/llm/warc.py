"""Web archives: a deterministic sharded writer, and a reader.

Pages in the order of id, digest and address are cut into shards of equal payload, and each shard is
written by one task as one gzip member per record; a file is closed once its compressed size reaches a
limit and the shard goes on in the next. The cuts are running sums of sizes and come from the pages
and the shard size alone. Headers, ids, dates and digests are made anew from the page, so the
same pages give the same files of the same bytes, whoever writes them and with whatever settings. A task writes under
a name of its own attempt; only names that a finished task reported are moved to their final place, in
a folder named after the pages, and a manifest, moved last, lists them. Readers read what the
manifest lists. A folder that has a manifest is not written to again.

Of pages with equal payloads only one, that with the largest id, carries it; the others are
``revisit`` records that name it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.llm.common import batches_of, kept_table, lookup, possible_member, with_python

DATE = "2024-01-01T00:00:00Z"
SHARD_BYTES = 64 << 20  # payload per shard, about
ROLL_BYTES = 16 << 20  # compressed size at which a file is closed
MOST_TASKS = 100_000  # beyond it, a task writes several shards one after the other
PAGES_AT_ONCE = 128  # pages a writing task holds
ORDER = ["page_id", "sha1", "url"]
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_system(uri: str):
    """The store of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    """A header value on one line, reversible."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One record: WARC headers, the HTTP head, and the payload unless it is a revisit."""
    digest = base32(hashlib.sha1(payload).hexdigest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
        if refers_to is not None:
            head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of PAGE from one record; digests and lengths are checked against the bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    at = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(at["Content-Length"])]
    if len(block) != int(at["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    if at["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError("record with a wrong digest")
    payload, kind = block.partition(b"\r\n\r\n")[2], at["WARC-Type"]
    digest = at["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(at["X-Payload-Length"]) if kind == "revisit" else len(payload)
    if kind == "response" and digest != base32(hashlib.sha1(payload).hexdigest()):
        raise ValueError("payload with a wrong digest")
    number = lambda name: int(at[name]) if name in at else None
    url = _unline(at["WARC-Target-URI"]) if "WARC-Target-URI" in at else None
    return number("X-Page-Id"), url, kind, number("X-Refers-To-Page-Id"), size, digest, None if kind == "revisit" else payload


def members(stream) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpack, held, left = zlib.decompressobj(31), [], b""
    while data := left or stream.read(1 << 20):
        held.append(unpack.decompress(data))
        left = b""
        if unpack.eof:
            yield b"".join(held)
            left, unpack, held = unpack.unused_data, zlib.decompressobj(31), []
    if held and any(held):
        raise ValueError("the file ends inside a record")


def _place(page: int | None, sha1: str, url: str | None) -> tuple:
    """A page's place in the order, nulls first."""
    return page is not None, page or 0, sha1, url is not None, url or ""


def _starts(slim: DataFrame, shard_bytes: int) -> list[tuple]:
    """The place of every shard's first page: pages whose sizes sum to less than a multiple of
    ``shard_bytes`` in front of them belong to the shard of that multiple.

    Sums run inside sorted ranges; the driver gets a number for each range and a place for each shard. How
    the ranges were drawn makes no difference to the sums.
    """
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    ranged = kept_table(slim.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes, offset, before = ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect(), 0, []
    for part, n in sizes:
        before.append((part, offset))
        offset += n
    spark = slim.sparkSession
    parts = spark.createDataFrame(before or [(0, 0)], "part int, offset long")
    # pages equal in all three are one place, so they stay together
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("n").over(Window.partitionBy("part", *ORDER))
    summed = ranged.select(*ORDER, "part", (inside - equal).alias("inside")).join(F.broadcast(parts), "part")
    shard = F.floor((F.col("offset") + F.col("inside")) / shard_bytes)
    null = [F.struct(F.col(c).isNotNull().alias("there"), F.col(c).alias("value")).alias(c) for c in ORDER]
    first = summed.groupBy(shard.alias("shard")).agg(F.min(F.struct(*null)).alias("at")).orderBy("shard")
    return [_place(*(r["at"][c]["value"] for c in ORDER)) for r in first.collect()]


def _version(slim: DataFrame) -> str:
    """A name that the pages alone give."""
    mark = lambda i: F.bit_xor(F.xxhash64(F.lit(i), *ORDER))
    return hashlib.sha1(repr(tuple(slim.agg(F.count(F.lit(1)), F.sum("n"), mark(1), mark(2)).first())).encode()).hexdigest()[:16]


def _has_manifest(spark: SparkSession, out: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_manifest")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write(
    pages: DataFrame, out: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Writes the archive and returns its manifest (shard, seq, temp, name, bytes, records).

    ``out`` is a folder that driver and executors share. A null html is empty; a null page id
    sorts first and is never preferred; of equal payloads (from ``min_bytes`` on) the
    largest id is the response, and rows that repeat that id too. No pages, no files. Pages of one id are
    cut into shards like others; only rows equal in id, payload and address stay together. A folder
    that already holds an archive is refused before anything is written.
    """
    spark = pages.sparkSession
    if _has_manifest(spark, out):
        raise FileExistsError(f"an archive is already in {out}")
    with_python(spark)
    named = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    slim = kept_table(named.select(*ORDER, "n"))
    groups = slim.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("best"))
    groups = kept_table(groups.where("copies > 1"))
    starts, folder = _starts(slim, shard_bytes), _version(slim)
    told = spark.sparkContext.broadcast(starts)

    @F.arrow_udf("long")
    def shard_of(page: pa.Array, sha1: pa.Array, address: pa.Array) -> pa.Array:
        places = map(_place, page.to_pylist(), sha1.to_pylist(), address.to_pylist())
        return pa.array([bisect.bisect_right(told.value, p) - 1 for p in places], pa.int64())

    key = F.xxhash64("sha1", "n")
    rows = possible_member(named.withColumn("key", key), "key", groups.withColumn("key", key), "several")
    total = slim.count()
    met = lookup(rows.where("several"), groups, ["sha1", "n"], "copies", total, "left")
    rows = met.unionByName(rows.where("NOT several"), allowMissingColumns=True)
    rows = rows.select("page_id", "url", "payload", "best", "sha1", shard_of(*ORDER).alias("shard"))
    tasks = max(1, min(len(starts), MOST_TASKS))
    placed = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / max(1, len(starts))).cast("int")).sortWithinPartitions(
        "shard", *[F.col(c).asc_nulls_first() for c in ORDER]).drop("sha1")
    schema = "shard long, seq long, temp string, name string, bytes long, records long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(out)
        attempt = f"{base}/_temporary/{uuid.uuid4().hex}"
        current, sink, told = None, None, []

        def close() -> None:
            sink.close()
            told.append(tuple(current.values()))

        for batch in batches:
            for page, address, payload, best, shard in zip(*(batch.column(i) for i in range(5))):
                page, best, shard = page.as_py(), best.as_py(), shard.as_py()
                if current is None or current["shard"] != shard or current["bytes"] >= roll_bytes:
                    seq = 0
                    if current is not None:
                        close()
                        seq = current["seq"] + 1 if current["shard"] == shard else 0
                    else:
                        store.create_dir(attempt)
                    name = f"part-{shard:06d}-{seq:04d}.warc.gz"
                    current = {"shard": shard, "seq": seq, "temp": f"{attempt}/{name}", "name": name, "bytes": 0, "records": 0}
                    sink = store.open_output_stream(current["temp"], compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(page, address.as_py(), payload.as_py(), best is not None and best != page, best)) + pack.flush()
                sink.write(data)
                current["bytes"] += len(data)
                current["records"] += 1
        if current is not None:
            close()
        columns = list(zip(*told)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "seq", "temp", "name", "bytes", "records"])

    with batches_of(spark, PAGES_AT_ONCE):
        written = kept_table(placed.mapInArrow(run, schema))
    return _commit(spark, written, out, folder)


def _commit(spark: SparkSession, written: DataFrame, out: str, folder: str) -> DataFrame:
    """Moves the files of finished tasks to their names, then the manifest; each move can be repeated."""
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = file_system(out)
        store.create_dir(f"{base}/{folder}")
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("name").to_pylist()):
                there = store.get_file_info([temp, f"{base}/{name}"])
                if there[0].type == fs.FileType.File:
                    store.move(temp, f"{base}/{name}")
                elif there[1].type != fs.FileType.File:
                    raise FileNotFoundError(temp)
            yield batch

    named = written.withColumn("name", F.concat(F.lit(f"{folder}/"), "name"))
    moved = named.mapInArrow(move, named.schema)
    hidden, final = f"{out}/_temporary/manifest", f"{out}/_manifest"
    moved.write.parquet(hidden)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    if _has_manifest(spark, out) or not store.rename(path(hidden), path(final)):
        raise FileExistsError(f"an archive is already in {out}")
    store.delete(path(f"{out}/_temporary"), True)
    return spark.read.schema(written.schema).parquet(final)


def read(spark: SparkSession, out: str, *, payloads: bool = True) -> DataFrame:
    """The records of an archive's manifest: the columns of PAGE (payload only on demand)."""
    with_python(spark)
    schema = PAGE if payloads else PAGE.removesuffix(", payload binary")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(out)
        made = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for data in members(stream):
                        rows.append(parse(data)[: len(names)])
                        size += len(data) if payloads else 256
                        if size >= 1 << 22:
                            yield made(rows)
                            rows, size = [], 0
                    yield made(rows)

    names_only = spark.read.parquet(f"{out}/_manifest").select("name")
    files = names_only.count()
    return names_only.repartition(max(1, min(files, 10_000))).mapInArrow(run, schema)
