"""WARC archives with revisit records, and a two-level capture index over them.

Writing: every page becomes a record, a gzip member of its own. Of pages with equal payloads of at least
``min_bytes`` bytes that with the largest id is a ``response``; the others are ``revisit`` records that refer to it and
carry its HTTP header without the payload. Tasks write files of their own to a shared folder, under names that no
other attempt uses; only files of committed tasks are indexed.

Index: captures are sorted by key (host labels reversed, path and query, then the id) into blocks of
``block_lines`` lines, compressed one by one. A sparse directory per index file keeps the first key of each block with
its place; the list of index files with their first keys is all that the driver holds. A lookup searches the files'
first keys, then the directory, then the block by bisection, and reads the record by its range.

Rows: a null page is an empty payload, a null url has an empty host and path. A null id is written as an empty one and
is smaller than any other. Repeated rows are archived each; rows that tie on the largest id are all responses.
Control characters and spaces of urls are percent-encoded in headers and keys.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._storage import prepare, scratch_path, written
from ._text import pieces

RESPONSE, REVISIT = "response", "revisit"
#: So many shared payloads (some 150 bytes each) are broadcast; more are joined, and each one's pages dealt so often.
BROADCAST_DIGESTS, _SALTS = 200_000, 32
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: Column, page_id: Column) -> Column:
    """Sort key of a capture: ``com,example,www)/path?query``, a space and the id in 16 hexadecimal digits."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(url)
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"^[^/?#]*((?s:.*))", 1)
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), tail)
    return F.concat(F.regexp_replace(surt, r"[\x00-\x20\x7f]", "%20"), F.lit(" "), F.lpad(F.hex(F.coalesce(page_id, F.lit(-(1 << 63)))), 16, "0"))


def _quoted(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {REVISIT if refers_to is not None else RESPONSE}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_quoted(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record: page_id, url, type, digest, refers_to, payload_bytes and payload (None in revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "type": kind,
        "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload": payload if kind == RESPONSE else None,
    }


def _store(uri: str):
    """File system and path of a shared folder; Python workers reach local, HDFS, S3 and GCS folders this way."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archive(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30
) -> DataFrame:
    """Write all pages below ``folder``; returns the captures (key, file, offset, length), a written table."""
    spark = pages.sparkSession
    prepare(spark)
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size")
    )
    # payloads are hashed where they are read; only digests are grouped
    shared = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("holder")).filter("n > 1 and holder is not null").drop("n")
    shared = written(shared, "shared-payloads", narrow=True)
    if shared.count() <= BROADCAST_DIGESTS:
        kept = rows.join(F.broadcast(shared), ["digest", "size"], "left")
    else:
        # a page that very many share is dealt to several tasks
        every = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
        kept = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int")).join(shared.withColumn("salt", every), ["digest", "size", "salt"], "left")
    kept = kept.select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("holder")), None).otherwise(F.col("holder")).alias("refers_to"), capture_key(F.col("url"), F.col("page_id")).alias("key")
    )
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        name, out, at = "", None, 0
        for batch in batches:
            for part in pieces(batch, "html"):
                keys, files, offsets, lengths = [], [], [], []
                for page_id, url, text, digest, refers_to, key in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = pack.compress(record(page_id, url, text.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, date)) + pack.flush()
                    out.write(data)
                    keys.append(key)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(data))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(kept.mapInArrow(write, "key string, file string, offset long, length long"), "captures")


class CaptureIndex:
    """Index files in key order: first key of each, its name and the place of its directory."""

    def __init__(self, folder: str, shards: list[tuple[bytes, str, int, int]]):
        self.folder, self.shards = folder, sorted(shards)
        self.firsts = [s[0] for s in self.shards]

    def reader(self) -> IndexReader:
        return IndexReader(self)


class IndexReader:
    """Lookups of one task; the directories and blocks used last stay in memory."""

    def __init__(self, index: CaptureIndex, kept: int = 16):
        self.index, self.kept = index, kept
        self.store, self.top = _store(index.folder)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.directories: OrderedDict[int, list] = OrderedDict()
        self.blocks: OrderedDict[tuple[int, int], tuple] = OrderedDict()

    def _cached(self, cache: OrderedDict, key, make):
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            if len(cache) > self.kept:
                cache.popitem(last=False)
        return cache[key]

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self._cached(self.files, name, lambda: self.store.open_input_file(f"{self.top}/{name}")).read_at(length, offset)

    def directory(self, shard: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        def make():
            _, name, offset, length = self.index.shards[shard]
            lines = [x.split(b"\t") for x in zlib.decompress(self.read(name, offset, length)).split(b"\n")]
            return [x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines]

        return self._cached(self.directories, shard, make)

    def block(self, shard: int, number: int) -> tuple[list[bytes], list[bytes]]:
        def make():
            lines = [x.split(b"\t", 1) for x in zlib.decompress(self.read(self.index.shards[shard][1], *self.directory(shard)[1][number])).split(b"\n")]
            return [x[0] for x in lines], [x[1] for x in lines]

        return self._cached(self.blocks, (shard, number), make)

    def lookup(self, key: bytes) -> list[tuple[str, int, int]]:
        """File, offset and length of every capture with this key. Equal keys may run on over blocks and files, so
        the search starts at the last block whose first key is smaller and goes on while keys are equal."""
        found = []
        shard = max(bisect_left(self.index.firsts, key) - 1, 0)
        while shard < len(self.index.shards) and self.index.firsts[shard] <= key:
            firsts = self.directory(shard)[0]
            number = max(bisect_left(firsts, key) - 1, 0)
            while number < len(firsts) and firsts[number] <= key:
                keys, rest = self.block(shard, number)
                for i in range(bisect_left(keys, key), bisect_right(keys, key)):
                    name, offset, length = rest[i].split(b"\t")
                    found.append((name.decode(), int(offset), int(length)))
                number += 1
            shard += 1
        return found


def build_index(captures: DataFrame, folder: str, *, block_lines: int = 2000, partitions: int | None = None) -> CaptureIndex:
    """Sort captures by key and write the index files beside the archives."""
    spark = captures.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        lines: list[bytes] = []
        directory: list[bytes] = []
        name, out, at = f"{uuid.uuid4().hex}.cdxz", None, 0

        def flush() -> None:
            nonlocal out, at
            if out is None:
                out = store.open_output_stream(f"{top}/{name}", compression=None)
            data = zlib.compress(b"\n".join(lines), 6)
            directory.append(b"%s\t%d\t%d" % (lines[0].split(b"\t", 1)[0], at, len(data)))
            out.write(data)
            at += len(data)
            lines.clear()

        for batch in batches:
            for key, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines.append(f"{key}\t{file}\t{offset}\t{length}".encode())
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = zlib.compress(b"\n".join(directory), 6)
            out.write(data)
            out.close()
            first = directory[0].split(b"\t", 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], names=["first", "name", "offset", "length"])

    ordered = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    shards = written(ordered.mapInArrow(write, "first binary, name string, offset long, length long"), "index-files").collect()
    return CaptureIndex(folder, [(bytes(r["first"]), r["name"], r["offset"], r["length"]) for r in shards])


def read_archive(keys: DataFrame, index: CaptureIndex, *, payloads: bool = False) -> DataFrame:
    """Records of every capture whose key is in the one column of ``keys``; a key asked for twice is read once.

    Keys are dealt by ranges and sorted, so a task reads its part of the index in order.
    """
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(index)
    column = keys.columns[0]
    asked = keys.select(F.col(f"`{column}`").alias("key")).distinct()
    asked = asked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                places = sorted(p for k in batch.column(0).slice(at, 256).to_pylist() for p in reader.lookup(k.encode()))
                found = [parse(zlib.decompress(reader.read(*p), 31)) for p in places]
                columns = [pa.array([r[f] for r in found], t) for f, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), *[("payload", pa.binary())] * payloads)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return asked.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads)


def archive_folder(pages: DataFrame) -> str:
    return scratch_path(pages.sparkSession, "archive")
