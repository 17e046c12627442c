"""Distances, strands, cleaning, windows, files."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspan.functions import sequences as fn
from seqspan.functions.kernel import pair_distances
from seqspan.operators.windows import locations, windows
from seqspan.sources import fasta
from tests.plain import dp, rc


def one_distance(a, b):
    return int(pair_distances(pa.array([a]), pa.array([b]))[0])


def test_distance_exhaustive(spark):
    left = ["".join(x) for x in itertools.product("ACN", repeat=3)]
    right = ["".join(x) for x in itertools.product("ACN", repeat=4)] + [""]
    pairs = spark.createDataFrame([(a, b, dp(a, b)) for a in left for b in right], "a string, b string, d int")
    cols = [fn.bounded_distance(F.col("a"), F.col("b"), t).alias(f"t{t}") for t in range(5)]
    for row in pairs.select("*", fn.distance(F.col("a"), F.col("b")).alias("exact"), *cols).collect():
        assert row.exact == row.d == one_distance(row.a, row.b)
        for t in range(5):
            assert row[f"t{t}"] == (row.d if row.d <= t else -1)


def test_distance_lengths(spark):
    rng = random.Random(20260917)
    rows = []
    for n in (0, 1, 63, 64, 65, 127, 128, 129, 150, 255, 256, 257):
        a, b = ("".join(rng.choice("ACGTN") for _ in range(k)) for k in (n, n + 1))
        rows += [(a, b, dp(a, b)), (b, a, dp(a, b)), (a, "", len(a)), (a, a[: n // 2] + "N" + a[n // 2 :], 1)]
    out = spark.createDataFrame(rows, "a string, b string, d int").select("*", fn.distance(F.col("a"), F.col("b")).alias("x"), fn.bounded_distance(F.col("a"), F.col("b"), 0).alias("zero"))
    for row in out.collect():
        assert row.x == row.d == one_distance(row.a, row.b)
        assert row.zero == (0 if row.d == 0 else -1)


def test_clean_and_reverse(spark):
    row = spark.createDataFrame([(" ac\tg\r\ntN\x0b\x0c", "acgtnR")], "a string, b string").select(fn.clean(F.col("a")), fn.reverse_complement(F.col("b"))).first()
    assert tuple(row) == ("ACGTN", rc("acgtnR"))


def test_floor_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 9, 3, 7, 2, 8, 6, 4, 10]] + [(None,)], "v double")
    row = fn.floor_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0}).first()
    assert (row.p50, row.p95, row.p99, row.p0) == (5.0, 9.0, 9.0, 1.0)


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_fasta_windows(spark, tmp_path):
    path = write(tmp_path, "r.fa", ">one description\nAACC\nAA\n\n>two\nttggtt\n")
    contigs = fasta.contig_windows(fasta.read_contigs(spark, path), 4)
    rows = {r.sequence_id: r for r in windows(contigs, 4).collect()}
    assert len(rows) == 6 and rows[0].seq == "AACC" and rows[3].seq == "TTGG"
    at = locations(spark.createDataFrame([(4,)], "sequence_id long"), contigs, 1).first()
    assert (at.contig, at.start) == ("two", 1)
    assert windows(fasta.contig_windows(fasta.read_contigs(spark, path), 4, 1, 4), 4).count() == 4


def test_fasta_odd_records(spark, tmp_path):
    text = "GG\n>\nAC\n>one\tx\nTT\n>short\nA\n> y\nCC\n>two\r\nGGGG\r\n>\nlost\n"
    rows = fasta.read_contigs(spark, write(tmp_path, "odd.fa", text)).orderBy("contig_ordinal").collect()
    assert [(r.name, r.bases) for r in rows] == [("one", "GGACTT"), ("short", "A"), ("two\r", "CCGGGG")]
    counts = fasta.contig_windows(fasta.read_contigs(spark, write(tmp_path, "odd.fa", text)), 4).orderBy("contig_ordinal").collect()
    assert [(r.window_count, r.first_sequence_id) for r in counts] == [(3, 0), (0, 3), (3, 3)]
    with pytest.raises(ValueError):
        fasta.contig_windows(fasta.read_contigs(spark, write(tmp_path, "odd.fa", text)), 4, 0)


def test_reads_both_formats(spark, tmp_path):
    fa = write(tmp_path, "q.fa", "\n\n>q1 full header\nAA\ncc\n>q2\n\n>q3\nTTGG")
    fq = write(tmp_path, "q.fq", "\n@q1 full header\naacc\n+\nIIII\n@q2\n\n+\n\n@q3\nTTGG\n+x\nIIII\n")
    want = [(0, "q1 full header", "AACC"), (1, "q2", ""), (2, "q3", "TTGG")]
    for path in (fa, fq):
        assert [tuple(r) for r in fasta.read_reads(spark, path).orderBy("ordinal").collect()] == want
        assert [tuple(r) for r in fasta.read_reads(spark, path, 1).collect()] == want[:1]


@pytest.mark.parametrize("text", ["", "\n\n", "ACGT\n", "@q\nAC\n+\n", "@q\nAC\nx\nII\n", "@q\nAC\n+\nII\n\n", "@q\nAC\n+\nII\nq\nAC\n+\nII\n"])
def test_reads_errors(spark, tmp_path, text):
    with pytest.raises(ValueError):
        fasta.read_reads(spark, write(tmp_path, "bad", text))


def test_from_sequences(spark):
    contigs, window, stride = fasta.from_sequences(spark, ["acgt", "TTTT"])
    rows = windows(fasta.contig_windows(contigs, window, stride), window, stride).orderBy("sequence_id").collect()
    assert [(r.contig, r.seq) for r in rows] == [("sequence_0", "ACGT"), ("sequence_1", "TTTT")]
    for bad in ([], [""], ["A", "AC"]):
        with pytest.raises(ValueError):
            fasta.from_sequences(spark, bad)


def test_windows_of_long_and_wide_contigs(spark):
    from seqspan.operators import windows as w
    from seqspan.sources.fasta import contig_windows

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACGT"), 3 * w.PIECE // 2)), "äbc" * 7, "", "ACG", "ACGTACGT"]
    contigs = spark.createDataFrame([(k, f"c{k}", s) for k, s in enumerate(texts)], "contig_ordinal long, name string, bases string")
    for stride, spread in ((1, False), (7, True)):
        placed = contig_windows(contigs, 5, stride)
        rows = sorted(w.windows(placed, 5, stride, spread).collect())
        want = [(f"c{k}", i, s[i : i + 5]) for k, s in enumerate(texts) for i in range(0, len(s) - 4, stride)]
        assert [(r.contig, r.start, r.seq) for r in rows] == want and [r.sequence_id for r in rows] == list(range(len(want)))
        ids = spark.createDataFrame([(k, k % 3) for k in range(0, len(want) + 50, 97)], "sequence_id long, more int")
        got = {r.sequence_id: (r.contig, r.start) for r in w.locations(ids, placed, stride).collect()}
        assert got == {k: want[k][:2] for k in range(0, len(want), 97)}


def test_folders_of_fasta_files(spark, tmp_path):
    from seqspan.sources.fasta import read_contigs

    (tmp_path / "a.fa").write_text(">one x\nAC\nGT\n>two\nAA\n")
    (tmp_path / "b.fa").write_text(">three\nCC\n")
    rows = sorted(read_contigs(spark, str(tmp_path)).collect())
    assert [(r.name, r.bases) for r in rows] == [("one", "ACGT"), ("two", "AA"), ("three", "CC")]
