"""The binary index file against a plain writer of the same format."""

import itertools
import struct

import numpy as np
import pyarrow as pa
import pytest

from seqspan.cli import main
from seqspan.config import BuildConfig, QueryConfig
from seqspan.operators import hierarchy, search
from seqspan.operators.windows import windows
from seqspan.sources import fasta, index_file, index_store

NONE = 2**64 - 1


def plain_file(index):
    """The file's bytes, node by node."""
    nodes = sorted(index.nodes.collect(), key=lambda r: r.node_id)
    members = sorted((r.leaf_id, r.member_ordinal, r.sequence_id, r.seq) for r in index.members.collect())
    beacons = sorted((r.parent_id, r.beacon_index, r.child_ordinal) for r in index.beacons.collect())
    table = sorted((r.parent_id, r.child_ordinal, r.beacon_index, r.distance) for r in index.beacon_distances.collect())
    children = sorted((r.parent_id, r.child_ordinal, r.node_id) for r in nodes if r.parent_id is not None)
    out = b"NVMIDX2\0" + struct.pack("<IIIIQQ", 2, index.window, index.stride, index.max_tolerance, index.windows, 0)
    for r in sorted(index.layers.collect()):
        out += struct.pack("<QQI", r.first_node, r.node_count, r.selection_radius)
    out += struct.pack("<Q", len(nodes))
    child = member = beacon = distance = 0
    for r in nodes:
        center = NONE if r.center_sequence_id is None else r.center_sequence_id
        out += struct.pack("<8QB", center, r.member_count, child, member, beacon, distance, r.child_count, r.beacon_count, r.layer)
        child, beacon, distance = child + r.child_count, beacon + r.beacon_count, distance + r.child_count * r.beacon_count
        member += r.member_count if r.layer == 2 else 0

    def texts(values):
        return struct.pack("<Q", len(values)) + b"".join(struct.pack("<Q", len(v.encode())) + v.encode() for v in values)

    def numbers(values, code):
        return struct.pack("<Q", len(values)) + b"".join(struct.pack(code, v) for v in values)

    out += texts([r.center_seq or "" for r in nodes]) + numbers([c for *_, c in children], "<Q")
    out += numbers([m[2] for m in members], "<Q") + texts([m[3] for m in members])
    return out + numbers([b[2] for b in beacons], "<Q") + numbers([t[3] for t in table], "<i")


def tables(index, coordinates=True):
    columns = {"members": ["leaf_id", "member_ordinal", "sequence_id", "seq"] + ["contig", "start"] * coordinates}
    return {name: sorted(map(str, getattr(index, name).select(*columns.get(name, getattr(index, name).columns)).collect())) for name in index.TABLES}


@pytest.fixture(scope="module")
def built(spark):
    texts = ["".join(x) for x in itertools.product("ACN", repeat=3)] + ["AAA"]
    contigs, window, stride = fasta.from_sequences(spark, texts)
    contigs = fasta.contig_windows(contigs, window, stride)
    return contigs, windows(contigs, window, stride), hierarchy.build(contigs, window, stride, BuildConfig((3, 3, 3), (0.4, 0.6, 0.5), 1))


@pytest.mark.parametrize("split", [1 << 26, 100])
def test_written_bytes_and_tables_read_back(spark, built, tmp_path, split):
    contigs, every, index = built
    folder, whole = tmp_path / "parts", tmp_path / "whole"
    index_file.save(index, str(folder))
    raw = b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))
    assert raw == plain_file(index)
    assert not list(folder.glob("_open*"))
    whole.write_bytes(raw)
    want = tables(index)
    for path in (folder, whole):
        loaded = index_file.load(spark, str(path), contigs, split)
        assert tables(loaded) == want
    assert tables(index_file.load(spark, f"file:{whole}"), False) == tables(index, False)
    reads = spark.createDataFrame([(0, "a", "ACN"), (1, "b", "NN"), (2, "c", "")], "ordinal long, name string, seq string")
    assert sorted(search.routed(reads, loaded, QueryConfig(both_strands=True)).collect()) == sorted(search.brute_force(reads, every, 1, True).collect())
    with pytest.raises(ValueError, match="already"):
        index_file.save(index, str(folder))


def test_windows_of_unlike_lengths(spark, tmp_path):
    """No window length to go by: the lengths are walked."""
    rows = [(k, f"c{k}", 0, s) for k, s in enumerate(["", "A", "ACGTACGT", "é" * 3, "AC", "ACGTACGA", "TTTTTTTTTTTTTTT"])]
    every = spark.createDataFrame(rows, "sequence_id long, contig string, start long, seq string")
    index = hierarchy.build_from_windows(every, 0, 1, BuildConfig((5, 4, 3), (0.5, 0.0, 1.0), 1))
    (tmp_path / "file").write_bytes(plain_file(index))
    for split in (1, 40, 1 << 26):
        assert tables(index_file.load(spark, str(tmp_path / "file"), split_bytes=split), False) == tables(index, False)
    index_file.save(index, str(tmp_path / "parts"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "parts").glob("part-*"))) == plain_file(index)


def test_splits_are_ranges_of_the_arrays(built, tmp_path):
    (tmp_path / "file").write_bytes(plain_file(built[2]))
    data = index_file.Bytes(str(tmp_path / "file"))
    head = index_file.header(data, "file")
    for split in (20, 65, 300):
        found = index_file.ranges(data, head, split)
        for array, parts in found.items():
            assert [p.first for p in parts] == list(np.cumsum([0] + [p.count for p in parts[:-1]])), array
            assert all(p.count * 4 <= split for p in parts)
        assert len(found["members"]) == -(-built[2].members.count() // max(1, split // 19))


def test_errors(spark, built, tmp_path):
    raw = plain_file(built[2])
    wrong = {"cannot open": None, "unsupported index format": b"other" + raw[5:], "unsupported index version 3": raw[:8] + struct.pack("<I", 3) + raw[12:]}
    wrong |= {f"truncated index#{n}": raw[:n] for n in (60, 300, len(raw) - 4, len(raw) - 1)} | {"truncated index#more": raw + b"x"}
    wrong["unsupported index format#empty"] = b""
    for k, (message, content) in enumerate(wrong.items()):
        path = tmp_path / f"f{k}"
        if content is not None:
            path.write_bytes(content)
        with pytest.raises(ValueError, match=message.split("#")[0]):
            index_file.load(spark, str(path))
    assert not index_file.is_file(str(tmp_path / "f0")) and not index_file.is_file(str(tmp_path / "f1"))


def test_command_line_takes_binary_indexes(spark, tmp_path, capsys):
    (tmp_path / "r.fa").write_text(">one\nAAAAAACC\n")
    (tmp_path / "q.fa").write_text(">q1\nAAAA\n>q2\nAAC\n")
    at = {k: str(tmp_path / k) for k in ("r.fa", "q.fa", "index", "out")}
    build = ["build", "--reference", at["r.fa"], "--index", at["index"], "--window", "4", "--T", "1", "--radii", "3,3,3", "--beacon-ratios", ".5,.5,.5"]
    assert main([*build, "--index-format", "other"], spark) == 1
    assert main([*build, "--index-format", "binary"], spark) == 0
    assert index_file.is_file(at["index"])
    golden = ["q1\tone\t%d\t%d\t+\t%d" % x for x in ((0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3))] + ["q2\tone\t3\t1\t+\t3", "q2\tone\t4\t1\t+\t4"]
    capsys.readouterr()
    assert main(["query", "--reference", at["r.fa"], "--index", at["index"], "--queries", at["q.fa"], "--tolerance", "1"], spark) == 0
    assert capsys.readouterr().out.splitlines()[1:7] == golden
    assert main(["query", "--index", at["index"], "--queries", at["q.fa"]], spark) == 1
    assert main(["verify", "--reference", at["r.fa"], "--index", at["index"], "--queries", at["q.fa"]], spark) == 0
    assert main(["inspect", "--index", at["index"]], spark) == 0
    assert "metric=leaf_memberships value=5" in capsys.readouterr().out


def test_parquet_indexes_are_no_files(built, tmp_path):
    index_store.save(built[2], str(tmp_path / "parquet"))
    assert not index_file.is_file(str(tmp_path / "parquet"))


def test_a_split_is_read_in_pieces_and_walked_once(spark, built, tmp_path, monkeypatch):
    """Batches are bounded, not as long as the split; splits that are found travel to the reader."""
    monkeypatch.setattr(index_file, "PIECE", 64)
    index = built[2]
    unlike = ["x" * 300, "", "ab", "é" * 40] * 5
    raw = index_file.encoded_texts(pa.array(unlike))
    (tmp_path / "file").write_bytes(raw)
    data, at, texts = index_file.Bytes(str(tmp_path / "file")), 0, []
    while at < len(raw):
        piece, lengths = index_file.piece_of(data, at, len(raw), 1 << 16, None)
        assert len(lengths) == 1 or len(piece) <= 64
        texts += index_file.decoded_texts(piece, lengths).to_pylist()
        at += len(piece)
    assert texts == unlike
    (tmp_path / "index").write_bytes(plain_file(index))
    path = str(tmp_path / "index")
    data = index_file.Bytes(path)
    part = index_file.ranges(data, index_file.header(data, path), 1 << 26)["members"]
    assert len(part) == 1
    batches = list(index_file.IndexReader(path, "members", 1 << 26).read(part[0]))
    assert len(batches) > 1 and all(b.num_rows <= 64 // 11 for b in batches)
    assert [x for b in batches for x in b.column("position").to_pylist()] == list(range(part[0].count))
    calls = []
    monkeypatch.setattr(index_file, "ranges", lambda *a: calls.append(a))
    reader = index_file.IndexReader(path, "members", 1 << 26, index_file.json.dumps([index_file.astuple(p) for p in part]))
    assert reader.partitions() == part and not calls


def test_places_and_many_contigs_are_not_broadcast(spark, built, tmp_path, monkeypatch):
    """Nodes are few and what they own is not: nothing that grows with it may pass the driver."""
    contigs, _, index = built
    contigs = spark.createDataFrame(contigs.collect(), contigs.schema)  # without their own plan
    (tmp_path / "file").write_bytes(plain_file(index))
    plans, kept = {}, index_file.kept

    def seen(df, folder, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, folder, name)

    monkeypatch.setattr(index_file, "kept", seen)
    monkeypatch.setattr(index_file, "registered", None)  # nor does a load plan a data source in processes beside the driver
    monkeypatch.setattr("seqspan.operators.windows.FEW", 27, raising=False)
    assert contigs.count() == 28
    assert tables(index_file.load(spark, str(tmp_path / "file"), contigs)) == tables(index)
    assert {"nodes", "members", "beacons", "beacon_distances"} <= plans.keys()
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
