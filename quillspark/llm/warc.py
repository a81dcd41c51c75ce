"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of bounded size. A bundle is a file of such frames that
ends in a seek table: a skippable frame with the sizes of all frames, in the public seekable format. An index
maps each record to its bundle, frame and offset in the frame's contents, so that any record is read by one
ranged read and the decoding of one frame, and frames are read back in parallel.

Executors write and read bundles through the file system of the folder given (``pyarrow.fs``: local and mounted
paths, HDFS and object stores). A task writes under a name of its own attempt and then renames, so tries that
are repeated or lost leave no half-written bundle that an index names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, shuffle_parts, whole
from quillspark.session import checkpoint_root, materialize

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
# Fixed values of the public formats: WARC/1.1 and the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"
INDEX = "page_id {id}, bundle string, frame int, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _header_value(text: str | None) -> str:
    """A value that can't break out of its header line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "none:")


def warc_record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the response holding it."""
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {_header_value(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        fields += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}", "WARC-Truncated: length"]
    block = HTTP_HEAD if is_revisit else HTTP_HEAD + payload
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names lower-cased), block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(fields["content-length"])
    return fields, data[end + 4 : end + 4 + size], end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of an open bundle, from its footer alone."""
    source.seek(size - 9)
    count, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if descriptor & 0x80 else 8
    source.seek(size - 9 - entry * count)
    table, at, out = source.read(entry * count), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def file_system(path: str):
    """The ``pyarrow`` file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``page_id, url, payload, refers_to, is_revisit``.

    Of pages with equal payloads of at least ``min_revisit_bytes``, that with the smallest id is the response.
    Rows that repeat this id with the same payload are responses too; a null id is never the smallest.
    Payloads are told apart by their SHA-256; only digests and ids are grouped, and what a payload is joined
    with is one small row for each group. A payload of a third of all pages makes one key of that join hot; its
    large partitions are split by Spark, as nothing above the join needs a key's rows together.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), whole(html).alias("payload"))
    rows = rows.withColumn("_same", F.sha2("payload", 256))
    groups = (
        rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("_same")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return rows.join(groups, "_same", "left").select(
        "page_id", "url", "payload", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("is_revisit")
    )


def write_archive(
    pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3,
    min_revisit_bytes: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url",
) -> DataFrame:
    """Write one record per row into bundles in ``folder`` and return the stored index.

    A frame closes when its records reach ``frame_bytes`` (a longer record has a frame of its own), a bundle
    when its frames reach ``bundle_bytes`` packed; a task holds one frame at a time and the sizes of the others.

    * Null html: an empty payload. Null url: a placeholder. Equal rows: a record each. Other columns are not read.
    * An empty table writes no bundle and gives an empty index.
    """
    bounded_batches(pages.sparkSession)
    id_type = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = file_system(folder)
        packer = zstandard.ZstdCompressor(level=level)
        out, name, sizes, at = None, "", [], 0
        held: list[tuple] = []
        held_bytes, index = 0, []

        def close_frame():
            nonlocal out, name, at, held, held_bytes
            if not held:
                return
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = fs.open_output_stream(f"{root}/.{name}", compression=None)
            packed = packer.compress(b"".join(r for _, r in held))
            out.write(packed)
            inside = 0
            for key, record in held:
                index.append((key, f"{folder}/{name}", len(sizes), at, len(packed), inside, len(record)))
                inside += len(record)
            sizes.append((len(packed), held_bytes))
            at += len(packed)
            held, held_bytes = [], 0
            if at >= bundle_bytes:
                close_bundle()

        def close_bundle():
            nonlocal out, sizes, at
            if out is not None:
                out.write(seek_table(sizes))
                out.close()
                fs.move(f"{root}/.{name}", f"{root}/{name}")
            out, sizes, at = None, [], 0

        def taken(schema):
            kinds = [schema.field(0).type, pa.string(), pa.int32(), *[pa.int64()] * 4]
            columns = list(zip(*index, strict=True)) or [()] * len(kinds)
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], INDEX_NAMES)

        schema = None
        for batch in batches:
            schema = batch.schema
            for key, target, payload, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = warc_record(key, target, payload.encode(), refers_to, is_revisit)
                held.append((key, record))
                held_bytes += len(record)
                if held_bytes >= frame_bytes:
                    close_frame()
            # records of an open frame are indexed when it closes
            if index:
                yield taken(schema)
        close_frame()
        close_bundle()
        if index:
            yield taken(schema)

    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    records = with_revisits(pages, min_revisit_bytes, page_id, html, url)
    return materialize(records.mapInArrow(run, INDEX.format(id=id_type)))


INDEX_NAMES = ["page_id", "bundle", "frame", "frame_at", "frame_bytes", "record_at", "record_bytes"]


def bundle_frames(bundles: DataFrame) -> DataFrame:
    """``bundle, frame, frame_at, frame_bytes`` of every frame, from the footers of the given bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as source:
                    rows += [(path, k, at, packed) for k, (at, packed, _) in enumerate(read_seek_table(source, source.size()))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bundle", "frame", "frame_at", "frame_bytes"]
            )

    return bundles.select("bundle").repartition(shuffle_parts(bundles.sparkSession), "bundle").mapInArrow(run, "bundle string, frame int, frame_at bigint, frame_bytes bigint")


_RECORD = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, payload binary"


def read_frames(frames: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the given frames, decoded frame by frame; ``payload`` is null for revisits.

    A response's payload is checked against its digest; one that differs ends the read with an error. With a column
    ``places`` (offsets in the frame) only the records that begin there are parsed.
    """
    n = shuffle_parts(frames.sparkSession)
    places = "places" if "places" in frames.columns else F.lit(None).cast("array<bigint>").alias("places")
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, _, at, packed, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as source:
                    source.seek(at)
                    data = unpacker.decompress(source.read(packed))
                rows, place, ahead = [], 0, iter(wanted or ())
                while place < len(data):
                    if wanted is not None and (place := next(ahead, None)) is None:
                        break
                    fields, block, place = parse_record(data, place)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    payload = block[len(HTTP_HEAD) :] if kind == "response" else None
                    if payload is not None and payload_digest(payload) != digest:
                        raise ValueError(f"{path}: {fields['warc-record-id']} does not match its digest")
                    refers = fields.get("warc-refers-to")
                    rows.append((
                        fields["warc-record-id"][1:-1], kind, refers and refers[1:-1], fields["warc-target-uri"], digest,
                        int(fields["x-payload-length"]), payload if with_payload else None,
                    ))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [*[pa.string()] * 5, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # frames are few small rows, so the number of tasks is stated: Spark would join them up by their bytes
    return frames.select("bundle", "frame", "frame_at", "frame_bytes", places).repartition(n, "bundle", "frame").mapInArrow(run, _RECORD)


def fetch_records(index: DataFrame, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the ids in ``wanted`` (column ``page_id``), reading only their frames, and in these only the records.

    A null id asks for the records of pages without one. Ids asked for twice count once; ids of several records give all.
    """
    ids = wanted.select(F.col("page_id").alias("_wanted")).distinct()
    found = index.join(ids, F.col("page_id").eqNullSafe(F.col("_wanted")), "left_semi")
    # a frame holds at most FRAME_BYTES of records
    places = found.groupBy("bundle", "frame", "frame_at", "frame_bytes").agg(F.array_sort(F.collect_list("record_at")).alias("places"))
    return read_frames(places, with_payload)


def archive_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/warc/{uuid.uuid4().hex}"


def archive_round_trip(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write the pages, read all bundles back by their seek tables, and return what the records say.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row per page row.
    """
    index = write_archive(pages, folder, **options)
    id_type = index.schema["page_id"].dataType
    read = read_frames(bundle_frames(index.select("bundle").distinct()), with_payload=False)
    number = lambda c: F.expr(f"try_cast(substr({c}, {len('urn:page:') + 1}) AS {id_type.simpleString()})")
    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )
