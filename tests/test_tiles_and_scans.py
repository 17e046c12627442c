"""Tiled distances, prefix sums, split files, ordered sinks and percentiles against plain models."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqspan.functions import kernel
from seqspan.functions import sequences as fn
from seqspan.operators import hierarchy, scan, tiles
from seqspan.operators.centers import choose_centers
from seqspan.operators.tables import kept, work_folder
from seqspan.sources import fasta, hits, splits
from tests.plain import dp, greedy

FAR = int(kernel.FAR)


def texts_of(rng, n, most=140, letters="ACGT"):
    return ["".join(rng.choice(list(letters), rng.integers(0, most))) for _ in range(n)] + ["", "é", "straße"]


@pytest.mark.parametrize("slice_", [1, 4096])
def test_tiles_equal_the_distance_matrix_within_every_limit(monkeypatch, slice_):
    """As blocks and as single pairs; each pair its own limit; both ways round."""
    monkeypatch.setattr(kernel, "_SLICE", slice_)
    rng = np.random.default_rng(1)
    a = texts_of(rng, 17)
    b = [x[: int(rng.integers(0, len(x) + 1))] + "".join(rng.choice(list("ACGTN"), 4)) for x in a for _ in range(2)]
    full = np.array([[dp(x, y) for y in b] for x in a])
    la, lb = kernel.letters(pa.array(a)), kernel.letters(pa.array(b))
    for limit in (None, np.full(len(a), 5), rng.integers(0, 90, len(a))):
        for allowed in (None, rng.random(full.shape) < 0.5, rng.random(full.shape) < 0.04):
            limit = None if limit is None else limit.astype(np.int32)
            want = full if limit is None else np.where(full <= limit[:, None], full, FAR)
            want = want if allowed is None else np.where(allowed, want, FAR)
            assert (kernel.tile_distances(la, lb, limit, None, allowed) == want).all()
            near = want <= want.min(1)[:, None] + 3
            got = kernel.tile_distances(la, lb, limit, 3, allowed)
            assert (got[near] == want[near]).all() and ((got == want) | (got == FAR)).all()
    other = rng.integers(0, 90, len(b)).astype(np.int32)
    assert (kernel.tile_distances(lb, la, other) == np.where(full.T <= other[:, None], full.T, FAR)).all()


@pytest.fixture
def small_tiles(monkeypatch):
    """Chunks of a few rows: a parent spreads over many tiles."""
    monkeypatch.setattr(tiles, "SIDE", 16)
    monkeypatch.setattr(tiles, "LEAST", 64)
    monkeypatch.setattr(tiles, "MOST", 64)


def sides(spark, seed=2, parents=4):
    rng = np.random.default_rng(seed)
    rows = [(int(p), i, "".join(rng.choice(list("ACG"), rng.integers(3, 9)))) for i, p in enumerate(rng.choice(parents, 150, p=[0.7, 0.2, 0.06, 0.04]))]
    folder = work_folder(spark)
    return rows[:100], rows[100:], *(kept(spark.createDataFrame(x, "parent long, id long, s string"), folder, n) for n, x in (("many", rows[:100]), ("few", rows[100:])))


def test_tile_joins(spark, small_tiles):
    many, few, left, right = sides(spark)
    near = {(p, i, j, dp(s, t)) for p, i, s in many for q, j, t in few if p == q}
    assert {tuple(r) for r in tiles.all_distances(left, right).collect()} == near
    limited = left.withColumn("most", F.lit(3))
    assert {tuple(r) for r in tiles.pairs_within(limited, right).collect()} == {x for x in near if x[3] <= 3}
    own = {(p, i, j, dp(s, t)) for p, i, s in many for q, j, t in many if p == q and j < i and dp(s, t) <= 3}
    assert {tuple(r) for r in tiles.pairs_within(limited, left, before=True).collect()} == own
    least = {}
    for p, i, j, d in near:
        if d <= 3:
            least[p, i] = min(j, least.get((p, i), j))
    assert {((r.parent, r.id), r.other) for r in tiles.least_within(limited, right).collect()} == set(least.items())
    for slack in (0, 2, 1 << 29):
        for r in tiles.nearest_within(left, right, slack).collect():
            mine = [(d, j) for p, i, j, d in near if (p, i) == (r.parent, r.id)]
            assert r.least == min(mine)[0] and [tuple(x) for x in r.near] == sorted(x for x in mine if x[0] <= r.least + slack) and r.calls == len(mine)


def test_triangle_bounds_and_limits_leave_pairs_out(spark, small_tiles):
    many, few, left, right = sides(spark, 3)
    beacons = ["ACGACG", "CCC"]
    bound = lambda rows: {(p, i): [dp(s, b) for b in beacons] for p, i, s in rows}
    x, y = bound(many), bound(few)
    give = lambda df, by: df.join(spark.createDataFrame([(*k, v) for k, v in by.items()], "parent long, id long, bounds array<int>"), ["parent", "id"])
    out = tiles.nearest_within(give(left, x).withColumn("most", F.lit(2)), give(right, y)).collect()
    texts = {(p, i): s for p, i, s in many + few}
    for r in out:
        mine = [(dp(texts[r.parent, r.id], t), j) for q, j, t in few if q == r.parent]
        open_ = [j for q, j, _ in few if q == r.parent and max(abs(a - b) for a, b in zip(x[r.parent, r.id], y[q, j], strict=True)) <= 2]
        assert r.calls == len(open_)
        assert (r.least, [tuple(v) for v in r.near]) == ((min(mine)[0], sorted(v for v in mine if v[0] == min(mine)[0])) if min(mine)[0] <= 2 else (None, []))


def test_centers_in_few_rounds_whatever_the_heads(spark):
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ACGT"), 400))
    rows = [(0, 7 * i, base[i : i + 12]) for i in range(388)]  # a chain: each is near the next
    rows += [(1, i, "".join(rng.choice(list("ACGT"), 12))) for i in range(60)]
    rows += [(2, i, "ACGTACGTACGT"[: 10 + i % 3]) for i in range(50)]  # dense: all near each other
    df = spark.createDataFrame(rows, "parent long, id long, s string").repartition(5)
    want = {(p, i) for q in range(3) for p, (i, _) in ((q, x) for x in greedy([(i, s) for p, i, s in rows if p == q], 4))}
    for head, pairs in ((3, 1 << 22), (40, 1), (10_000, 1)):
        folder = work_folder(spark)
        got = choose_centers(df, 4, folder, "c", head, pairs).collect()
        assert {(r.parent, r.center_id) for r in got} == want
        for p in range(3):
            mine = sorted((r.child_ordinal, r.center_id) for r in got if r.parent == p)
            assert [k for k, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)


def test_many_centers_take_a_logarithm_of_rounds(spark, monkeypatch):
    from seqspan.operators import centers

    rounds = []
    monkeypatch.setattr(centers, "settled", lambda *x, real=centers.settled: rounds.append(1) or real(*x))
    rng = np.random.default_rng(5)
    rows = [(0, i, "".join(x)) for i, x in enumerate(rng.choice(list("ACGT"), (3000, 20)))]
    got = centers.choose_centers(spark.createDataFrame(rows, "parent long, id long, s string"), 5, work_folder(spark), "c", head=16)
    assert got.count() > 2000 and len(rounds) <= 9


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_sums(spark, parts):
    rng = np.random.default_rng(6)
    keys = rng.permutation(500).tolist()
    rows = [(k // 50, k, int(k % 5)) for k in keys]
    df = kept(spark.createDataFrame(rows, "g long, k long, v long").repartition(parts), work_folder(spark), "rows")
    order, total = {}, 0
    for g, k, v in sorted(rows):
        order[k] = total
        total += v
    out = scan.prefix_sums(df, ["k"], "v", "before", work_folder(spark))
    assert {r.k: r.before for r in out.collect()} == order and out.columns == ["g", "k", "v", "before"]
    assert {r.k: r.n for r in scan.prefix_sums(df, ["k"], None, "n", work_folder(spark)).collect()} == {k: k for k in keys}
    assert {r.k: r.place for r in scan.ranks(df, "g", "k", "place", work_folder(spark)).collect()} == {k: k % 50 for k in keys}
    assert scan.prefix_sums(df.limit(0), ["k"], "v", "before", work_folder(spark)).count() == 0


# ---------------------------------------------------------------- files


@pytest.fixture
def small_splits(spark):
    """Splits of 60 bytes, most of them cut inside a record."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_contigs(texts):
    out, name, bases = [], "", ""
    pending = ""
    for text in texts:
        for k, part in enumerate(("\n" + text).split("\n>")):
            header, _, rest = part.partition("\n") if k else ("", "", part)
            name = re.match("[^ \t]*", header)[0]
            bases = re.sub(r"[ \t\n\x0b\f\r]", "", rest).upper()
            if not k and not bases:
                continue
            pending += bases
            if name:
                out.append((len(out), name, pending))
                pending = ""
    return out


def test_contigs_over_many_splits_and_files(spark, tmp_path, small_splits):
    rng = np.random.default_rng(7)
    texts = []
    for f in range(3):
        lines = ["ac gt"] if f == 1 else []
        for k in range(40):
            nameless = rng.random() < 0.15
            lines.append(">" if nameless else f">c{f}_{k}\tmore > words")
            lines += ["".join(rng.choice(list("acgt"), rng.integers(0, 50))) for _ in range(rng.integers(0, 4))]
        texts.append("\n".join(lines) + "\n")
        (tmp_path / f"{f}.fa").write_text(texts[-1])
    got = fasta.read_contigs(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == plain_contigs(texts)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.fa").write_text(re.sub(">\n", ">x\n", texts[0]))
    clean = fasta.read_contigs(spark, str(tmp_path / "one"))
    assert sorted(tuple(r) for r in clean.collect()) == plain_contigs([re.sub(">\n", ">x\n", texts[0])])
    assert "Exchange" not in re.sub("BroadcastExchange", "", clean._jdf.queryExecution().executedPlan().toString())  # no text is moved


def test_fastq_over_many_splits_and_files(spark, tmp_path, small_splits):
    rng = np.random.default_rng(8)
    want = []
    for f in range(3):
        lines = ["", ""] if f == 0 else []
        for k in range(50):
            seq = "".join(rng.choice(list("acgtn"), rng.integers(0, 70)))
            lines += [f"@r{f}_{k} x", seq, "+", "@" * len(seq)]  # qualities that look like headers
            want.append((len(want), f"r{f}_{k} x", seq.upper()))
        (tmp_path / f"{f}.fq").write_text("\n".join(lines) + "\n")
    for size in ("60", "1000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert sorted(tuple(r) for r in fasta.read_reads(spark, str(tmp_path)).collect()) == want
    for limit in (1, 7, 60, 149, 400):
        assert sorted(tuple(r) for r in fasta.read_reads(spark, str(tmp_path), limit).collect()) == want[:limit]
    (tmp_path / "3.fq").write_text("@cut\nAC\n+\n")
    with pytest.raises(ValueError, match="truncated"):
        fasta.read_reads(spark, str(tmp_path))
    assert fasta.read_reads(spark, str(tmp_path), 150).count() == 150


def input_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).inputBytes() for k in range(stages.size()))


@pytest.mark.parametrize("suffix", ["fa", "fq"])
def test_a_limit_ends_the_reading(spark, tmp_path, suffix):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    read = []
    for n in (4_000, 40_000):
        record = (lambda k: f">r{k}\n{'ACGT' * 20}\n") if suffix == "fa" else (lambda k: f"@r{k}\n{'ACGT' * 20}\n+\n{'I' * 80}\n")
        path = tmp_path / f"{n}.{suffix}"
        path.write_text("".join(record(k) for k in range(n)))
        before = input_bytes(spark)
        rows = fasta.read_reads(spark, str(path), 20).collect()
        read.append(input_bytes(spark) - before)
        assert sorted(r.ordinal for r in rows) == list(range(20)) and {r.seq for r in rows} == {"ACGT" * 20}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(read) < 6 * 65536 < 40_000 * 86 / 8  # a few splits of either file


def test_sinks_write_ordered_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = [(k % 50, f"q{k % 50}", "c", k, k % 3, "+-"[k % 2], 100 - k) for k in range(100)]
    df = spark.createDataFrame(rows, "ordinal long, query string, contig string, start long, distance int, strand string, sequence_id long").repartition(4)
    hits.write_tsv(df, str(tmp_path / "out"))
    hits.write_fasta(df.select("sequence_id", F.col("sequence_id").alias("ordinal"), F.col("query").alias("name"), F.lit("ACGT").alias("seq")), str(tmp_path / "fa"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    want = sorted(rows, key=lambda r: (r[0], r[6], "+-".index(r[5]), r[4]))
    assert len([p for p in parts if p.stat().st_size]) > 2
    assert lines == [hits.HEADER] + ["\t".join(map(str, (r[1], r[2], r[3], r[4], r[5], r[6]))) for r in want]
    assert sorted(map(tuple, hits.read_tsv(spark, str(tmp_path / "out")).collect())) == sorted(tuple(r[1:]) for r in rows)
    assert [r.name for r in fasta.read_reads(spark, str(tmp_path / "fa")).orderBy("ordinal").collect()] == [f"q{r[0]}" for r in sorted(rows, key=lambda r: r[6])]


# ---------------------------------------------------------------- percentiles and plans


@pytest.mark.parametrize("kind", ["double", "long", "int", "decimal(20,3)"])
def test_percentiles_by_refined_histograms(spark, monkeypatch, kind):
    from decimal import Decimal

    monkeypatch.setattr(fn, "BUCKETS", 5)
    rng = np.random.default_rng(9)
    make = {"double": float, "long": lambda v: int(v * 1000), "int": lambda v: int(v), "decimal(20,3)": lambda v: Decimal(f"{v:.3f}")}[kind]
    values = [make(v) for v in np.concatenate([rng.lognormal(3, 2, 300), -rng.lognormal(2, 1, 50), np.full(100, 7.5)])]
    if kind == "double":
        values += [math.inf, -math.inf, -math.inf, 1e308, -1e308, 5e-324, 0.0]
    if kind == "long":
        values += [2**63 - 1, -(2**63), 2**62, 2**62 + 1]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
    fractions = {f"p{k}": k / 20 for k in range(21)}
    row = fn.floor_percentiles(df, "v", fractions).first()
    want = sorted(values)
    assert [row[x] for x in fractions] == [want[int(p * (len(want) - 1))] for p in fractions.values()]
    assert fn.floor_percentiles(df.limit(0), "v", {"p50": 0.5}).first().p50 is None


def test_percentiles_put_nan_last(spark):
    row = fn.floor_percentiles(spark.createDataFrame([(math.nan,), (1.0,), (2.0,)], "v double"), "v", {"a": 0.0, "b": 0.5, "c": 1.0}).first()
    assert (row.a, row.b) == (1.0, 2.0) and math.isnan(row.c)


@pytest.mark.parametrize("name", ["window_ids", "fasta_contigs", "fasta_reads", "fastq_reads", "latency_percentiles", "passage_build", "tsv_round_trip"])
def test_no_task_sees_all_rows(spark, monkeypatch, name):
    """No plan of these queries, those of its stored tables included, has a single partition of rows."""
    from pyspark.sql import DataFrameWriter

    from seqspan.plans import registry

    plans = []
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for form in ("parquet", "text"):
        monkeypatch.setattr(DataFrameWriter, form, lambda self, *x, real=getattr(DataFrameWriter, form), **k: (see(self._df), real(self, *x, **k))[1])
    see(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    for plan in plans:
        for window in re.finditer(r"(?m)^.*\bWindow \[.*windowspecdefinition\(([^)]*)", plan):
            assert "specifiedwindowframe" in window[0] and re.match(r"\w+#\d+", window[1])
        # sums of everything (one row a task) may meet in one partition, windows and sorts may not
        assert not re.search(r"(?m)(Window|Sort) [^\n]*\n(?:[^\n]*(?:Sort|Project|WholeStage|Filter)[^\n]*\n)*[^\n]*Exchange SinglePartition", plan)
