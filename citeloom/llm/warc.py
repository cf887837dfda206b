"""Operator 9: WARC records in seekable Zstandard bundles.

Pages become WARC/1.1 response records. The records of a bundle are grouped into frames of
about frame_bytes, each compressed by itself, and a seek table in a skippable frame ends the
bundle, in the seekable format: for each frame its compressed and decompressed size, then the
number of frames, a descriptor byte and the magic number. Any Zstandard decoder reads such a
file from the start; with the seek table one record costs one frame.

Pages are dealt to bundles by a hash of their id, the number of bundles following the bytes
of the input. A task writes each bundle by itself under a name made of its number, first to a
name of its own and then by rename, so a repeated or lost task leaves the same one file. The
index, which maps each record id to bundle, frame and offset within the frame, is written beside
the bundles; the operator writes once, when it is called, and returns the stored index. What
tasks that were lost left behind is removed then.

Defined results: a null page_id gives no record, since nothing could ask for it; a null html
is an empty body and a null url an empty target; control characters of a url, which would end
its header, are percent-encoded; each of several rows of one page_id has a record of its own,
told apart by ordinal; a page longer than a frame is a frame by itself; other columns are
ignored. An empty table gives no bundle and an empty index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import files, shared_dir

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"
_FIELDS = "page_id long, ordinal int, record_id string, bundle string, frame int, offset int, length int, frame_start long, frame_size int, body_crc long"


_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]")


def header_url(url: str) -> str:
    """The url with control characters and line breaks percent-encoded, so that it stays one header."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def record_id(page_id: int, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{ordinal}')}>"


def record(page_id: int, ordinal: int, url: str, body: bytes) -> bytes:
    head = (
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {record_id(page_id, ordinal)}\r\nWARC-Date: {_DATE}\r\n"
        f"WARC-Target-URI: {header_url(url)}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if not first.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("not one WARC record")
    return headers, rest[:length]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame for (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer


def _storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, gs, abfs) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def read_seek_table(path: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame of a bundle, from its last bytes alone."""
    store, place = _storage(path)
    with store.open_input_file(place) as file:
        end = file.size()
        n, descriptor, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != _SEEKABLE or descriptor & 0x80:
            raise ValueError(f"{path} has no seek table that this reads")
        sizes = struct.iter_unpack("<II", file.read_at(8 * n, end - 9 - 8 * n))
    start, found = 0, []
    for packed, plain in sizes:
        found.append((start, packed, plain))
        start += packed
    return found


def read_record(path: str, frame: int, offset: int, length: int) -> bytes:
    """One record, by decompressing only its frame."""
    start, packed, plain = read_seek_table(path)[frame]
    store, place = _storage(path)
    with store.open_input_file(place) as file:
        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, start), max_output_size=plain)
    return data[offset : offset + length]


def bundle_pages(
    pages: DataFrame, path: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL
) -> DataFrame:
    """Writes bundles to `path`, a new folder in the shared one by default, where they stay, and returns their index.

    Columns: page_id, ordinal, record_id, bundle (file name), frame, offset and length within the
    decompressed frame, frame_start and frame_size in the file, body_crc (CRC-32 of the body).
    All is written when this returns; the index is the Parquet table `index` of the folder.
    """
    spark = pages.sparkSession
    folder = path or f"{shared_dir(spark)}/citeloom-warc/{uuid.uuid4().hex}"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), text("url").alias("url"), text("html").alias("html"))
    total = pages.agg(F.sum(F.octet_length("html") + 300)).first()[0] or 0
    n = max(1, -(-total // bundle_bytes))
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(a, types[b]) for a, b in (f.split() for f in _FIELDS.split(", "))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _storage(folder)
        store.create_dir(place, recursive=True)
        state: dict = {"bundle": None}
        done: list[list] = []

        def flush() -> None:
            if not state["held"]:
                return
            plain = b"".join(r for r, _ in state["held"])
            packed = zstandard.ZstdCompressor(level=level, write_content_size=True).compress(plain)
            state["file"].write(packed)
            offset = 0
            for data, (page, ordinal, crc) in state["held"]:
                done.append([page, ordinal, record_id(page, ordinal), state["name"], len(state["frames"]), offset, len(data), state["start"], len(packed), crc])
                offset += len(data)
            state["frames"].append((len(packed), len(plain)))
            state["start"] += len(packed)
            state["held"], state["size"] = [], 0

        def close() -> None:
            if state["bundle"] is None:
                return
            flush()
            state["file"].write(seek_table(state["frames"]))
            state["file"].close()
            store.move(state["own"], f"{place}/{state['name']}")
            state["bundle"] = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for bundle, page, url, html, ordinal, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != state["bundle"]:
                    close()
                    name = f"bundle-{bundle:08d}.warc.zst"
                    own = f"{place}/.{name}.{uuid.uuid4().hex}"
                    state.update(bundle=bundle, name=name, own=own, file=store.open_output_stream(own), held=[], size=0, frames=[], start=0)
                body = html.encode("utf-8", "surrogatepass")
                data = record(page, ordinal, url, body)
                if state["size"] and state["size"] + len(data) > frame_bytes:
                    flush()
                state["held"].append((data, (page, ordinal, crc)))
                state["size"] += len(data)
            if len(done) > 10_000:
                yield out()
        close()
        yield out()

    bundle = F.pmod(F.xxhash64("page_id"), F.lit(n)).cast("int")
    ordinal = F.row_number().over(Window.partitionBy("bundle", "page_id").orderBy("url", "html")) - 1
    dealt = pages.select(bundle.alias("bundle"), "page_id", "url", "html").repartition("bundle")
    dealt = dealt.withColumn("ordinal", ordinal).withColumn("crc", F.crc32(F.encode("html", "utf-8"))).sortWithinPartitions("bundle", "page_id", "ordinal")
    dealt.mapInArrow(write, _FIELDS).write.mode("overwrite").parquet(f"{folder}/index")
    store, place = files(spark, f"{folder}/.bundle-*")
    for left in store.globStatus(place) or ():
        store.delete(left.getPath(), False)
    return spark.read.schema(_FIELDS).parquet(f"{folder}/index")
