"""The binary index file: a Python data source that reads and writes it by ranges.

The file is a header, then arrays one after the other, each behind its length: nodes, their
center texts, children, member ids of the leaves, their texts, beacon ordinals and beacon
distances.  A node owns runs of these arrays by a first place and a count; numbers are
little-endian.

* **Reading.**  Where arrays lie follows from the header and their lengths, so every split is
  a range of places and no task sees a whole array.  Texts have the window's length (the
  root's is empty), which every task checks; where they have not, their lengths are walked
  once to find the splits.  A task reads and decodes a split a piece at a time, so its memory
  does not depend on the size of the split.
* **Writing.**  First places are prefix sums over the nodes.  Every task writes the run of
  places it holds to a file of its own; one commit renames them, in order, to ``part-*``.
  These parts one after the other are the file (``cat path/part-* > file``), and a folder of
  them is read like it.

Paths are those of pyarrow's file systems (local, hdfs, s3)."""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from seqspan.config import FORMAT_VERSION
from seqspan.operators.hierarchy import SequenceIndex
from seqspan.operators.scan import prefix_sums_of
from seqspan.operators.tables import kept, partitions_of, work_folder
from seqspan.operators.windows import locations

# The file's format.
MAGIC = b"NVMIDX2\0"
HEADER = struct.Struct("<8sIIIIQQ" + "QQI" * 3 + "Q")  # version, window, stride, T, windows, root; three layers; nodes
NODE = np.dtype([
    ("center_sequence_id", "<u8"), ("member_count", "<u8"), ("first_child", "<u8"), ("first_member", "<u8"), ("first_beacon", "<u8"),
    ("first_distance", "<u8"), ("child_count", "<u8"), ("beacon_count", "<u8"), ("layer", "u1"),
])

ROOT_LAYER, LEAF_LAYER = 3, 2
SPLIT = 64 << 20
PIECE, PLACES = 4 << 20, 1 << 16  # bytes of texts and places that a task holds at a time
RUN = 1 << 20  # places that a task writes, from which on there are more tasks
SCHEMAS = {
    "nodes": "position long, " + ", ".join(f"{c} long" for c in NODE.names) + ", text string", "children": "position long, value long",
    "members": "position long, value long, text string", "beacons": "position long, value long", "distances": "position long, value int",
}


class Bytes:
    """A file, or the parts of a folder one after the other, read at any place."""

    def __init__(self, path: str) -> None:
        self.fs, root = located(path)
        info = self.fs.get_file_info(root)
        found = [info]
        if info.type == pafs.FileType.Directory:
            found = [f for f in self.fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-")]
        if not found or info.type == pafs.FileType.NotFound:
            raise ValueError(f"cannot open index for reading: {path}")
        self.files = [(f.path, f.size) for f in sorted(found, key=lambda f: f.base_name)]
        self.size = sum(size for _, size in self.files)

    def read(self, at: int, n: int) -> bytes:
        out = []
        for path, size in self.files:
            if n and at < size:
                with self.fs.open_input_file(path) as f:
                    out.append(f.read_at(min(n, size - at), at))
                n, at = n - len(out[-1]), at + len(out[-1])
            at -= size
        if n:
            raise ValueError("truncated index")
        return b"".join(out)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "/", path)))


@dataclass
class Header:
    window: int
    stride: int
    max_tolerance: int
    windows: int
    root: int
    layers: list[tuple[int, int, int]]
    nodes: int


def header(data: Bytes, path: str) -> Header:
    if data.size < len(MAGIC) or data.read(0, len(MAGIC)) != MAGIC:
        raise ValueError(f"unsupported index format: {path}")
    _, version, *rest = HEADER.unpack(data.read(0, HEADER.size))
    if version != FORMAT_VERSION:
        raise ValueError(f"unsupported index version {version}")
    return Header(*rest[:5], layers=[tuple(rest[k : k + 3]) for k in (5, 8, 11)], nodes=rest[14])


@dataclass
class Range(InputPartition):
    """``count`` places from ``first``: their numbers at ``at``, their texts (if any) at ``texts``
    with this ``width``; None: told by their lengths alone."""

    first: int
    count: int
    at: int
    texts: int = 0
    texts_end: int = 0
    width: int | None = None
    root: int = -1


def ranges(data: Bytes, head: Header, split: int) -> dict[str, list[Range]]:
    """Splits of all arrays, which must fill the file to its end."""
    try:
        return _ranges(data, head, split, head.window)
    except ValueError:
        return _ranges(data, head, split, None)


def _ranges(data: Bytes, head: Header, split: int, width: int | None) -> dict[str, list[Range]]:
    end = HEADER.size
    out: dict[str, list[Range]] = {}

    def take(size: int) -> int:
        """The place of ``size`` bytes that come next."""
        nonlocal end
        end += size
        if end > data.size:
            raise ValueError("truncated index")
        return end - size

    def length() -> int:
        return struct.unpack("<Q", data.read(take(8), 8))[0]

    def numbers(name: str, size: int) -> None:
        n = length()
        at, each = take(n * size), max(1, split // size)
        out[name] = [Range(p, min(each, n - p), at + p * size) for p in range(0, n, each)]

    def with_texts(name: str, n: int, at: int, size: int, root: int) -> None:
        if length() != n:
            raise ValueError("truncated index")
        if width is None:
            cuts = walked(data, end, n, split)
            take(cuts[-1][1] - end)
        else:
            start, each = take(n * (8 + width) - width * (0 <= root < n)), max(1, split // (8 + width + size))
            cuts = [(p, start + p * (8 + width) - width * (0 <= root < p)) for p in [*range(0, n, each), n]]
        out[name] = [Range(p, q - p, at + p * size, a, b, width, root) for (p, a), (q, b) in pairwise(cuts)]

    with_texts("nodes", head.nodes, take(head.nodes * NODE.itemsize), NODE.itemsize, head.root)
    numbers("children", 8)
    n = length()
    with_texts("members", n, take(n * 8), 8, -1)
    numbers("beacons", 8)
    numbers("distances", 4)
    if end != data.size:
        raise ValueError("truncated index")
    return out


def walked(data: Bytes, at: int, n: int, split: int) -> list[tuple[int, int]]:
    """``(place, byte)`` of a text about every ``split`` bytes, and of the end."""
    cuts, block, start = [(0, at)], b"", at
    for p in range(n):
        if at - cuts[-1][1] >= split:
            cuts.append((p, at))
        if at + 8 > start + len(block):
            block, start = data.read(at, min(1 << 20, max(8, data.size - at))), at
        at += 8 + struct.unpack_from("<Q", block, at - start)[0]
        if at > data.size:
            raise ValueError("truncated index")
    return [*cuts, (n, at)] if n else cuts


def piece_of(data: Bytes, at: int, end: int, most: int, lengths: np.ndarray | None) -> tuple[bytes, np.ndarray]:
    """The next texts from ``at``, ``most`` or about ``PIECE`` bytes but one at least, and their lengths: the
    first of ``lengths``, or read from the file."""
    if lengths is not None:
        lengths = lengths[: max(1, int(np.searchsorted(np.cumsum(lengths[:most] + 8), PIECE, "right")))]
        return data.read(at, int((lengths + 8).sum())), lengths
    raw, seen, size = data.read(at, min(PIECE, end - at)), [], 0
    while len(seen) < most and size + 8 <= len(raw):
        n = struct.unpack_from("<Q", raw, size)[0]
        if at + size + 8 + n > end:
            raise ValueError("truncated index")
        if size + 8 + n > len(raw):
            if seen:
                break
            raw = data.read(at, 8 + n)
        seen.append(n)
        size += 8 + n
    if not seen:
        raise ValueError("truncated index")
    return raw[:size], np.array(seen, np.int64)


def decoded_texts(raw: bytes, lengths: np.ndarray) -> pa.Array:
    """Texts behind their lengths, which must be as expected."""
    places, body = placed(lengths)
    cells = np.frombuffer(raw, np.uint8)
    if (cells[places].view("<u8") != lengths).any():
        raise ValueError("truncated index: a text is not as long as the window")
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(cells[body].tobytes()))


def placed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that hold lengths, and a mask of those that hold texts."""
    ends = np.cumsum(lengths + 8)
    places = ((ends - lengths - 8)[:, None] + np.arange(8)).ravel()
    body = np.ones(ends[-1] if len(ends) else 0, bool)
    body[places] = False
    return places, body


def encoded_texts(texts: pa.Array) -> bytes:
    texts = texts.cast(pa.binary())
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    places, body = placed(lengths)
    cells = np.empty(len(body), np.uint8)
    cells[places] = lengths.astype("<u8").view(np.uint8)
    cells[body] = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    return cells.tobytes()


class IndexFileSource(DataSource):
    """``spark.read.format("seqspan_index").option("array", ...)``, once ``registered``: places and values of
    one array; writing takes ``(section, position, places, data)``, see ``save``."""

    @classmethod
    def name(cls) -> str:
        return "seqspan_index"

    def schema(self) -> str:
        return SCHEMAS[self.options["array"]]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return IndexReader(self.options["path"], self.options["array"], int(self.options.get("split_bytes", SPLIT)), self.options.get("splits"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return IndexWriter(self.options["path"])


class IndexReader(DataSourceReader):
    def __init__(self, path: str, array: str, split: int, splits: str | None = None) -> None:
        self.path, self.array, self.split, self.splits = path, array, split, splits

    def partitions(self) -> list[Range]:
        if self.splits is not None:  # found before
            return [Range(*r) for r in json.loads(self.splits)] or [Range(0, 0, 0)]
        data = Bytes(self.path)
        return ranges(data, header(data, self.path), self.split)[self.array] or [Range(0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        data = Bytes(self.path)
        kind = {"nodes": NODE, "distances": np.dtype("<i4")}.get(self.array, np.dtype("<u8"))
        done, text_at = 0, part.texts
        while done < part.count:
            n, texts = min(PLACES, part.count - done), None
            if self.array in ("nodes", "members"):
                lengths = None
                if part.width is not None:
                    lengths = np.full(n, part.width, np.int64)
                    lengths[np.arange(part.first + done, part.first + done + n) == part.root] = 0
                raw, lengths = piece_of(data, text_at, part.texts_end, n, lengths)
                n, text_at, texts = len(lengths), text_at + len(raw), decoded_texts(raw, lengths)
            values = np.frombuffer(data.read(part.at + done * kind.itemsize, n * kind.itemsize), kind)
            columns = {"position": pa.array(np.arange(part.first + done, part.first + done + n))}
            if self.array == "nodes":
                columns |= {c: pa.array(values[c].astype(np.int64)) for c in NODE.names}
            else:
                columns["value"] = pa.array(values.astype(np.int32 if kind.itemsize == 4 else np.int64))
            if texts is not None:
                columns["text"] = texts
            done += n
            yield pa.RecordBatch.from_pydict(columns)
        if part.texts_end and text_at != part.texts_end:
            raise ValueError("truncated index")


@dataclass
class Runs(WriterCommitMessage):
    """``(section, first place, places, file)`` that a task wrote."""

    runs: list[tuple[int, int, int, str]]


class IndexWriter(DataSourceWriter):
    """Runs of places, each a file; an attempt that is lost leaves a file that no commit names."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> Runs:  # noqa: ANN001
        fs, root = located(self.path)
        fs.create_dir(root, recursive=True)
        runs: list[list] = []
        out = None
        for row in iterator:
            if not runs or (row.section, row.position) != (runs[-1][0], runs[-1][1] + runs[-1][2]):
                if out:
                    out.close()
                runs.append([row.section, row.position, 0, f"{root}/_open-{uuid.uuid4().hex}"])
                out = fs.open_output_stream(runs[-1][3])
            out.write(bytes(row.data))
            runs[-1][2] += row.places
        if out:
            out.close()
        return Runs([tuple(r) for r in runs])

    def commit(self, messages: list[Runs]) -> None:
        fs, root = located(self.path)
        runs = sorted(r for m in messages if m for r in m.runs)
        for a, b in pairwise(runs):
            if b[1] != (a[1] + a[2] if a[0] == b[0] else 0):
                raise ValueError(f"places of the index do not join: {a[:3]}, {b[:3]}")
        for k, run in enumerate(runs):
            fs.move(run[3], f"{root}/part-{k:08d}")
        self._clear(fs, root)

    def abort(self, messages: list[Runs]) -> None:
        fs, root = located(self.path)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            self._clear(fs, root)

    @staticmethod
    def _clear(fs: pafs.FileSystem, root: str) -> None:
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith("_open-"):
                fs.delete_file(f.path)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(IndexFileSource)
    return spark


def node_offsets(nodes: DataFrame, folder: str) -> DataFrame:
    """``nodes`` and the first places of what each owns, in order of node ids."""
    own = nodes.withColumns({
        "members_held": F.when(F.col("layer") == LEAF_LAYER, F.col("member_count")).otherwise(0),
        "distances_held": F.col("beacon_count") * F.col("child_count"),
    })
    held = {"first_child": "child_count", "first_member": "members_held", "first_beacon": "beacon_count", "first_distance": "distances_held"}
    return kept(prefix_sums_of(own, ["node_id"], held, folder), folder, "node_offsets")


def _runs(rows: DataFrame, section: int, kind: np.dtype | None, many: int) -> DataFrame:
    """``rows(position, ...)``, ``many``, as encoded runs, each task a range of places.  ``kind`` None:
    texts.  A writer's task gets its runs in one batch, so beyond ``RUN`` places a task there are
    more tasks."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if kind is None:
                raw = encoded_texts(b.column("value"))
            elif kind.names:
                cells = np.empty(b.num_rows, kind)
                for c in kind.names:
                    cells[c] = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).astype(kind[c])
                raw = cells.tobytes()
            else:
                raw = b.column("value").to_numpy(zero_copy_only=False).astype(np.int64).astype(kind).tobytes()
            yield pa.RecordBatch.from_pydict({"section": pa.array([section], pa.int32()), "position": b.column("position").slice(0, 1), "places": pa.array([b.num_rows]), "data": pa.array([raw], pa.binary())})

    few = many <= RUN * partitions_of(rows.sparkSession)
    dealt = rows.repartitionByRange("position") if few else rows.repartitionByRange(-(-many // RUN), "position")
    return dealt.sortWithinPartitions("position").mapInArrow(encode, "section int, position long, places long, data binary")


def save(index: SequenceIndex, path: str) -> None:
    """Writes ``path``, a new folder, as parts of the binary file."""
    spark = index.nodes.sparkSession
    fs, root = located(path)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise ValueError(f"there is something already: {path}")
    folder = work_folder(spark)
    nodes = node_offsets(index.nodes, folder)
    first = lambda column: nodes.select(F.col("node_id").alias("owner"), F.col(column).alias("first"), "beacon_count")
    at = lambda rows, owner, column, place: rows.join(first(column), rows[owner] == F.col("owner")).withColumn("position", F.col("first") + place)
    children = at(nodes.where("parent_id is not null").select("parent_id", "child_ordinal", "node_id"), "parent_id", "first_child", F.col("child_ordinal"))
    members = kept(at(index.members, "leaf_id", "first_member", F.col("member_ordinal")).select("position", "sequence_id", "seq"), folder, "members_placed")
    beacons = at(index.beacons, "parent_id", "first_beacon", F.col("beacon_index").cast("long"))
    distances = at(index.beacon_distances, "parent_id", "first_distance", F.col("child_ordinal") * F.col("beacon_count") + F.col("beacon_index"))
    value = lambda rows, column: rows.select("position", F.col(column).alias("value"))
    placed_nodes = nodes.withColumn("position", F.col("node_id"))
    fields = placed_nodes.select("position", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in NODE.names])
    texts = placed_nodes.select("position", F.coalesce("center_seq", F.lit("")).alias("value"))
    total = nodes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("child_count", "members_held", "beacon_count", "distances_held")], F.count("*").alias("nodes")).first()
    layers = [x for r in index.layers.orderBy("layer").collect() for x in (r.first_node, r.node_count, r.selection_radius)]
    head = HEADER.pack(MAGIC, FORMAT_VERSION, index.window, index.stride, index.max_tolerance, index.windows, 0, *layers, total.nodes)
    lengths = [total.nodes, total.child_count, total.members_held, total.members_held, total.beacon_count, total.distances_held]
    sizes = [total.nodes, *lengths]
    bodies = [
        (fields, NODE), (texts, None), (value(children, "node_id"), np.dtype("<u8")), (value(members, "sequence_id"), np.dtype("<u8")),
        (value(members, "seq"), None), (value(beacons, "child_ordinal"), np.dtype("<u8")), (value(distances, "distance"), np.dtype("<i4")),
    ]
    heads = [head, *[struct.pack("<Q", n) for n in lengths]]
    out = spark.createDataFrame([(2 * k, 0, 1, h) for k, h in enumerate(heads)], "section int, position long, places long, data binary")
    for k, (rows, kind) in enumerate(bodies):
        out = out.unionByName(_runs(rows, 2 * k + 1, kind, sizes[k]))
    writer, names = IndexWriter(path), ["section", "position", "places", "file"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = writer.write(Row(**r) for b in batches for r in b.to_pylist()).runs
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

    try:  # by the data source itself, its planning would hold five more Python processes on the driver
        runs = out.mapInArrow(write, "section int, position long, places long, file string").collect()  # one row a part
        writer.commit([Runs([tuple(r) for r in runs])])
    except Exception:
        writer.abort([])
        raise


def _owned(nodes: DataFrame, first: str, count: str, step: int = 1 << 16) -> DataFrame:
    """``(owner, ordinal, position, beacon_count)`` of all places that nodes own; long runs are cut,
    and dealt to all tasks, before they are unrolled."""
    each = nodes.where(F.col(count) > 0).select("position", F.col(first).alias("first"), F.col(count).alias("n"), "beacon_count")
    cut = each.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    dealt = cut.repartition(partitions_of(nodes.sparkSession), "position", "from")
    one = dealt.withColumn("ordinal", F.explode(F.sequence("from", F.least(F.col("from") + step, F.col("n")) - 1)))
    return one.select(F.col("position").alias("owner"), "ordinal", (F.col("first") + F.col("ordinal")).alias("position"), "beacon_count")


def is_file(path: str) -> bool:
    """Whether ``path`` holds a binary index, whole or in parts."""
    try:
        data = Bytes(path)
        return data.size >= len(MAGIC) and data.read(0, len(MAGIC)) == MAGIC
    except (ValueError, OSError, pa.ArrowInvalid):
        return False


def load(spark: SparkSession, path: str, contigs: DataFrame | None = None, split_bytes: int = SPLIT) -> SequenceIndex:
    """The index in the file or folder ``path``.  The file holds no coordinates: contig and start
    are null unless ``contigs`` (see sources.fasta.contig_windows) are given.

    Raises ValueError for a path that cannot be read, another format or version, and a file
    whose arrays do not end where it does."""
    data = Bytes(path)
    head = header(data, path)
    splits = ranges(data, head, split_bytes)

    def array(name: str) -> DataFrame:
        reader = IndexReader(path, name, split_bytes)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.column("split").to_pylist():
                    yield from reader.read(Range(*json.loads(r)))

        each = spark.createDataFrame([(json.dumps(astuple(r)),) for r in splits[name]], "split string")
        return each.mapInArrow(read, SCHEMAS[name])

    # A few nodes own any number of places, which Spark takes to be as small as the nodes: never broadcast.
    owned = lambda rows, first, count, name: _owned(rows, first, count).join(array(name).hint("merge"), "position")
    folder = work_folder(spark)
    nodes = kept(array("nodes"), folder, "nodes_read")
    kids = owned(nodes, "first_child", "child_count", "children")
    kids = kids.select(F.col("owner").alias("parent_id"), F.col("ordinal").alias("child_ordinal"), F.col("value").alias("position"))
    inner = F.col("layer") != ROOT_LAYER
    full = nodes.join(kids, "position", "left").select(
        F.col("position").alias("node_id"), F.col("layer").cast("int").alias("layer"), "parent_id", "child_ordinal", F.when(inner, F.col("center_sequence_id")).alias("center_sequence_id"),
        F.when(inner, F.col("text")).alias("center_seq"), "member_count", "child_count", "beacon_count",
    )
    held = owned(nodes.where(F.col("layer") == LEAF_LAYER), "first_member", "member_count", "members")
    members = held.select(F.col("owner").alias("leaf_id"), F.col("ordinal").alias("member_ordinal"), F.col("value").alias("sequence_id"), F.col("text").alias("seq"))
    if contigs is None:
        members = members.select("*", F.lit(None).cast("string").alias("contig"), F.lit(None).cast("long").alias("start"))
    else:
        members = locations(members, contigs, head.stride)
    beacons = owned(nodes, "first_beacon", "beacon_count", "beacons")
    beacons = beacons.select(F.col("owner").alias("parent_id"), F.col("ordinal").cast("int").alias("beacon_index"), F.col("value").alias("child_ordinal"))
    sized = nodes.withColumn("distances_held", F.col("beacon_count") * F.col("child_count"))
    table = owned(sized, "first_distance", "distances_held", "distances")
    table = table.select(
        F.col("owner").alias("parent_id"), F.floor(F.col("ordinal") / F.col("beacon_count")).alias("child_ordinal"),
        (F.col("ordinal") % F.col("beacon_count")).cast("int").alias("beacon_index"), F.col("value").alias("distance"),
    )
    meta = spark.createDataFrame([(FORMAT_VERSION, head.window, head.stride, head.max_tolerance, head.windows)], "format_version int, window int, stride int, max_tolerance long, reference_window_count long")
    layers = spark.createDataFrame([(k, *layer) for k, layer in enumerate(head.layers)], "layer int, first_node long, node_count long, selection_radius long")
    return SequenceIndex(
        meta, layers, kept(full, folder, "nodes"), kept(members, folder, "members"), kept(beacons, folder, "beacons"), kept(table, folder, "beacon_distances"),
        head.window, head.stride, head.max_tolerance, head.windows,
    )
