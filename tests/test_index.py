"""Hierarchy, search, verification, storage and command line against plain models."""

import itertools

import numpy as np
import pytest

from seqspan.cli import main
from seqspan.config import BuildConfig, QueryConfig, triple
from seqspan.operators import hierarchy, inspection, search
from seqspan.operators.reads import generate_reads
from seqspan.operators.windows import windows
from seqspan.sources import fasta, index_store
from tests.plain import Tree, brute, dp, greedy, rc


def made(spark, texts, radii, ratios, t):
    contigs, window, stride = fasta.from_sequences(spark, texts)
    contigs = fasta.contig_windows(contigs, window, stride)
    return windows(contigs, window, stride), hierarchy.build(contigs, window, stride, BuildConfig(radii, ratios, t))


def check_tree(index, tree):
    nodes = {r.node_id: r for r in index.nodes.collect()}
    members = {}
    for r in index.members.collect():
        members.setdefault(r.leaf_id, []).append((r.member_ordinal, r.sequence_id))
    number, above = 1, [0]
    for layer, worlds in enumerate(tree.layers):
        here = []
        for p, c, inside in worlds:
            row = nodes[number]
            assert (row.layer, row.parent_id, row.center_sequence_id, row.member_count) == (layer, above[p], c, len(inside))
            if layer == 2:
                assert [i for _, i in sorted(members[number])] == inside
            here.append(number)
            number += 1
        above = here
    assert len(nodes) == number
    stats = {r.build_layer: r for r in index.build_stats.collect()}
    for name, want in zip(("large", "middle", "small"), tree.stats, strict=True):
        r = stats[name]
        got = (r.center_edit_calls, r.beacon_table_edit_calls, r.member_beacon_edit_calls, r.candidate_edit_calls, r.classification_center_pairs, r.pruned_center_pairs, r.classified_members)
        assert got == (want["center"], want["table"], want["mb"], want["cand"], want["pairs"], want["pruned"], want["members"])


def reads_of(spark, texts):
    return spark.createDataFrame([(k, f"q{k}", s) for k, s in enumerate(texts)], "ordinal long, name string, seq string")


def found(df):
    return {(r.ordinal, r.sequence_id, r.strand, r.distance) for r in df.collect()}


def expected(texts, reads, t, both, hits=brute):
    out = set()
    for k, s in enumerate(reads):
        for strand, q in (("+", s), ("-", rc(s)))[: 1 + both]:
            out |= {(k, i, strand, d) for i, d in hits(texts, q, t)}
    return out


def test_pruning_boundary(spark):
    texts = ["AAAAAAAAAA", "CCCCAAAAAA", "CCCCCCCCCC", "CAAAAAAAAA", "CAAAAAAAAA"]
    _, index = made(spark, texts, (3, 3, 3), (0.1, 0.1, 0.1), 1)
    check_tree(index, Tree(texts, (3, 3, 3), (0.1, 0.1, 0.1), 1))
    large = index.build_stats.where("build_layer = 'large'").first()
    assert (large.member_beacon_edit_calls, large.candidate_edit_calls, large.pruned_center_pairs) == (2, 2, 2)


def test_exclusive_centers_differ_from_brute_force(spark):
    with pytest.warns(UserWarning):
        every, index = made(spark, ["AAAA", "AACC"], (1, 1, 1), (0.1, 0.1, 0.1), 1)
    reads = reads_of(spark, ["AAAC"])
    assert found(search.routed(reads, index)) == {(0, 0, "+", 1)}
    assert found(search.brute_force(reads, every, 1)) == {(0, 0, "+", 1), (0, 1, "+", 1)}
    row = search.verify(reads, index, every).first()
    assert (row.expected_hits, row.observed_hits, row.false_negatives, row.false_positives) == (2, 1, 1, 0)


def test_exhaustive_corpus(spark, tmp_path):
    texts = ["".join(x) for x in itertools.product("ACN", repeat=4)]
    texts.append(texts[0])
    reads = ["".join(x) for n in (3, 4, 5) for x in itertools.product("ACN", repeat=n)] + ["", "TTTT"]
    every, index = made(spark, texts, (3, 3, 3), (0.4, 0.6, 0.5), 1)
    tree = Tree(texts, (3, 3, 3), (0.4, 0.6, 0.5), 1)
    check_tree(index, tree)
    assert index.members.count() == 1136
    index_store.save(index, str(tmp_path / "index"))
    loaded = index_store.load(spark, str(tmp_path / "index"))
    df = reads_of(spark, reads)
    for both, t in itertools.product((False, True), (0, 1)):
        want = expected(texts, reads, t, both)
        assert found(search.routed(df, index, QueryConfig(t, both))) == want
        assert found(search.by_segments(df, every, 4, t, both)) == want
        if t:
            assert found(search.routed(df, loaded, QueryConfig(t, both))) == found(search.brute_force(df, every, t, both)) == want
    full, scan = (search.query_stats(df, index, QueryConfig(route=r)).first() for r in ("multilateration", "scan"))
    for k in range(3):
        assert full[f"edits_{k}"] + full[f"pruned_{k}"] == scan[f"edits_{k}"] and scan[f"pruned_{k}"] == 0
    assert full.leaf_members == scan.leaf_members == full.exact_verifications
    with pytest.raises(ValueError):
        search.routed(df, index, QueryConfig(2))


def test_long_windows(spark):
    base = "".join("ACGT"[x % 4] for x in np.random.RandomState(20260917).randint(0, 2**32, 230, dtype=np.uint32))
    texts = [base[k : k + 150] for k in range(0, 81, 2)] + ["N" * 150] * 2 + [base[:150]]
    reads = []
    for w in texts[::5]:
        changed = w[:37] + ("C" if w[37] == "A" else "A") + w[38:]
        reads += [w, changed, changed[:80] + "N" + changed[80:], w[:55] + w[56:]]
    reads.append("N" * 150)
    every, index = made(spark, texts, (60, 35, 15), (0.25, 0.5, 0.75), 2)
    check_tree(index, Tree(texts, (60, 35, 15), (0.25, 0.5, 0.75), 2))
    df, want = reads_of(spark, reads), expected(texts, reads, 2, True)
    assert found(search.routed(df, index, QueryConfig(2, True))) == want == found(search.by_segments(df, every, 150, 2, True))
    assert sum(s == "+" for _, _, s, _ in want) == 42


def test_palindrome_has_both_strands(spark):
    every, index = made(spark, ["ACGT", "GGGG"], (3, 3, 3), (1.0, 1.0, 1.0), 1)
    assert found(search.routed(reads_of(spark, ["ACGT"]), index, QueryConfig(0, True))) == {(0, 0, "+", 0), (0, 0, "-", 0)}


def test_rounds_of_centers_do_not_change_them(spark):
    from seqspan.operators.centers import choose_centers
    from seqspan.operators.tables import work_folder
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(int(p), i, "".join(rng.choice(list("ACG"), 5))) for i, p in enumerate(rng.integers(0, 3, 90))]
    df = spark.createDataFrame(rows, "parent long, id long, s string")
    for radius in (1, 2):
        want = {(p, i) for q in range(3) for p, (i, _) in ((q, x) for x in greedy([(i, s) for p, i, s in rows if p == q], radius))}
        for head in (1, 7, 1000):
            got = choose_centers(df, radius, work_folder(spark), "b", head)
            assert {(r.parent, r.center_id) for r in got.select("parent", "center_id").collect()} == want
    assert got.agg(F.min("child_ordinal")).first()[0] == 0
    assert choose_centers(df.limit(0), 2, work_folder(spark), "none").count() == 0


def test_batched_distances_are_exact():
    import pyarrow as pa

    from seqspan.functions.kernel import pair_distances

    rng = np.random.default_rng(1)
    a, b = ["", "", "é", "straße", "AC"], ["", "ACG", "e", "strasse", ""]
    for n in (0, 1, 3, 50, 63, 64, 65, 127, 128, 129, 150, 200):
        for k in range(8):
            x = list("".join(rng.choice(list("ACGT"), n)))
            a.append("".join(x))
            for at in rng.integers(0, max(1, n), k) if n else ():
                x[at] = "".join(rng.choice(list("ACGTN"), rng.integers(0, 3)))
            b.append("".join(x) if k % 3 else "".join(rng.choice(list("ACGT"), rng.integers(0, 160))))
    assert pair_distances(pa.array(a), pa.array(b)).tolist() == [dp(x, y) for x, y in zip(a, b, strict=True)]
    assert pair_distances(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []


def test_config_errors():
    assert triple("1,2,3", int) == (1, 2, 3)
    assert triple("0,2147483648,4294967295", int) == (0, 2**31, 2**32 - 1)
    for text in ("1,2", "1,,3", "1,2,3,4", "1,2,x", "1,2,4294967296", "1,2,-1"):
        with pytest.raises(ValueError):
            triple(text, int)
    for bad in ({"beacon_ratios": (2.0, 0, 0)}, {"beacon_ratios": (float("nan"), 0, 0)}, {"max_tolerance": -1}):
        with pytest.raises(ValueError):
            BuildConfig(**bad)


def test_radii_and_tolerances_above_signed_numbers(spark, tmp_path):
    """Everything is within such a radius: one world a level, and every window is a hit."""
    texts = ["ACGT", "TTTT", "ACCT"]
    every, index = made(spark, texts, (2**32 - 1, 2**31, 2**31), (0.5, 0.5, 0.5), 2**32 - 1)
    index_store.save(index, str(tmp_path / "i"))
    index = index_store.load(spark, str(tmp_path / "i"))
    assert index.max_tolerance == 2**32 - 1 and index.nodes.count() == 4
    df, want = reads_of(spark, ["ACGT", ""]), expected(texts, ["ACGT", ""], 9, True)
    for config in (QueryConfig(None, True), QueryConfig(2**31, True, "scan")):
        assert found(search.routed(df, index, config)) == want
    assert found(search.brute_force(df, every, 2**32 - 1, True)) == want


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_seed_hits_equal_brute_force_over_all_windows(spark, monkeypatch, most):
    """Whole contigs at stride 1, cut into pieces; and without a broadcast where seeds are many."""
    from seqspan.operators import seeds

    monkeypatch.setattr(seeds, "PIECE", 37)
    monkeypatch.setattr(seeds, "SEEDS", most)
    rng = np.random.default_rng(12)
    contigs = ["".join(rng.choice(list("ACGT"), n)) for n in (300, 14, 15, 40)] + ["", "é" * 3 + "".join(rng.choice(list("ACGT"), 50))]
    reads = []
    for c in (contigs[0], contigs[5]):
        for at in range(0, len(c) - 15, 9):
            w = c[at : at + 15]
            reads += [w, w[:7] + w[8:], w[:3] + "N" + w[3:], w[:5] + "T" + w[6:]]
    reads += ["", "ACG"]
    df = spark.createDataFrame([(k, f"c{k}", s) for k, s in enumerate(contigs)], "contig_ordinal long, name string, bases string")
    placed = fasta.contig_windows(df, 15, 1)
    every = [c[i : i + 15] for c in contigs for i in range(len(c) - 14)]
    out = seeds.seed_hits(reads_of(spark, reads), placed, 15, 2, True)
    want = expected(every, reads, 2, True)
    assert found(out) == want and len(want) > 200
    starts = {r.sequence_id: (r.contig, r.start) for r in windows(placed, 15).collect()}
    assert all(starts[r.sequence_id] == (r.contig, r.start) for r in out.collect())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.fa").write_text(">one\nAAAAAACC\n")
    (tmp_path / "q.fa").write_text(">q1\nAAAA\n>q2\nAAC\n")
    (tmp_path / "q.fq").write_text("@q1\nAAAA\n+\nIIII\n@q2\nAAC\n+\nIII\n")
    at = {k: str(tmp_path / k) for k in ("r.fa", "q.fa", "q.fq", "index", "out", "gen")}
    assert main(["build", "--reference", at["r.fa"], "--index", at["index"], "--window", "4", "--T", "1", "--radii", "3,3,3", "--beacon-ratios", ".5,.5,.5", "--threads", "2"], spark) == 0
    capsys.readouterr()
    golden = ["query\tcontig\tstart\tdistance\tstrand\tsequence_id"] + ["q1\tone\t%d\t%d\t+\t%d" % x for x in ((0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3))] + ["q2\tone\t3\t1\t+\t3", "q2\tone\t4\t1\t+\t4"]
    assert main(["query", "--index", at["index"], "--queries", at["q.fa"], "--tolerance", "1"], spark) == 0
    assert capsys.readouterr().out.splitlines()[:7] == golden
    assert main(["query", "--index", at["index"], "--queries", at["q.fq"], "--route", "scan", "--no-cache", "--output", at["out"]], spark) == 0
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text().splitlines() == golden
    assert main(["verify", "--index", at["index"], "--reference", at["r.fa"], "--queries", at["q.fa"], "--both-strands"], spark) == 0
    assert "false_negatives=0 false_positives=0" in capsys.readouterr().out
    assert main(["inspect", "--index", at["index"]], spark) == 0
    assert "metric=leaf_memberships value=5" in capsys.readouterr().out
    assert main(["benchmark", "--index", at["index"], "--queries", at["q.fa"], "--repeat", "2", "--warmup", "1"], spark) == 0
    assert main(["query", "--index", at["index"], "--queries", at["q.fa"], "--tolerance", "2"], spark) == 1
    assert main(["nonsense"], spark) == 0
    capsys.readouterr()
    assert main(["benchmark", "stray", "--unknown", "x", "--index", at["index"], "--queries", at["q.fa"], "--repeat", "3"], spark) == 0
    out = capsys.readouterr().out
    assert "queries=6 " in out and all(x in out for x in ("p50_us=", "p95_us=", "p99_us=", "mean_latency_us=", "peak_rss_bytes=", "avg_cache_candidates=0.0"))
    for wrong in (["--threads", "0"], ["--block-size", "0"], ["--repeat", "0"], ["--repeat"], ["--route", "other"]):
        assert main(["benchmark", "--index", at["index"], "--queries", at["q.fa"], *wrong], spark) == 1
    (tmp_path / "none.fa").write_text("\n")
    assert main(["query", "--index", at["index"], "--queries", str(tmp_path / "none.fa")], spark) == 1
    assert main(["query", "--queries", at["q.fa"]], spark) == 1
    assert main(["generate", "--reference", at["r.fa"], "--output", at["gen"], "--count", "12", "--window", "4"], spark) == 0
    lines = next((tmp_path / "gen").glob("part-*")).read_text().splitlines()
    assert len(lines) == 24 and lines[0] == ">q0_source0_steps0_none" and lines[1] == "AAAA" and lines[18] == ">q9_random_nohit"


def test_version_is_checked(spark, tmp_path):
    from pyspark.sql import functions as F

    _, index = made(spark, ["ACGT"], (3, 3, 3), (0.0, 0.0, 0.0), 1)
    index.meta = index.meta.withColumn("format_version", F.lit(1))
    index_store.save(index, str(tmp_path / "old"))
    with pytest.raises(ValueError):
        index_store.load(spark, str(tmp_path / "old"))
    assert inspection.size_in_memory(index).first().index_bytes > 0


@pytest.mark.parametrize("mode", ["ordered", "repeated", "shuffled"])
def test_generated_reads(spark, mode):
    source = spark.createDataFrame([(k, "ACGTACGTAC"[k % 4 :] + "GG"[: k % 4]) for k in range(7)], "sequence_id long, seq string")
    rows = sorted(generate_reads(source, 40, 10, 7, 5, mode, 10).collect())
    assert [r.ordinal for r in rows] == list(range(40))
    assert sum(r.name.endswith("_random_nohit") for r in rows) == 4
    if mode == "ordered":
        texts = dict(source.collect())
        for r in rows:
            if "_source" in r.name:
                start, edits = int(r.name.split("_source")[1].split("_")[0]), int(r.name.split("_steps")[1].split("_")[0])
                assert search_distance(r.seq, texts[start]) <= edits == r.ordinal % 6
    if mode == "repeated":
        assert {r.seq for r in rows if "random" not in r.name} == {source.where("sequence_id = 3").first().seq}


def search_distance(a, b):
    from tests.plain import dp

    return dp(a, b)


def test_streaming_reads(spark, tmp_path):
    from seqspan.streaming.reads import search_stream

    _, index = made(spark, ["AAAA", "CCCC"], (3, 3, 3), (0.5, 0.5, 0.5), 1)
    reads = reads_of(spark, ["AAAC", "CCCC"])
    reads.write.parquet(str(tmp_path / "in"))
    stream = search_stream(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.processAllAvailable()
    stream.stop()
    assert found(spark.read.parquet(str(tmp_path / "out"))) == {(0, 0, "+", 1), (1, 1, "+", 0)}


def test_query_stats_multilateration_equals_its_sql(spark):
    from pathlib import Path

    import duckdb

    from seqspan.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    want = con.execute(registry.oracle_sql()["query_stats_multilateration"])
    got = registry.queries()["query_stats_multilateration"](spark, sf)
    assert got.columns == [d[0] for d in want.description]
    assert [tuple(r) for r in got.collect()] == want.fetchall()
