"""The stored seed table against all windows compared one by one."""

import shutil

import numpy as np
import pytest

from seqspan.operators import seed_table
from seqspan.operators.windows import windows
from seqspan.sources import fasta
from tests.plain import brute
from tests.test_index import expected, found, reads_of


def placed(spark, texts, window):
    df = spark.createDataFrame([(k, f"c{k}", s) for k, s in enumerate(texts)], "contig_ordinal long, name string, bases string")
    return fasta.contig_windows(df, window, 1)


def edited(w, rng, most):
    x = list(w)
    for at in rng.integers(0, len(x), rng.integers(0, most + 1)):
        x[at] = rng.choice(["", "A", "N", x[at] + "G"])
    return "".join(x)


@pytest.mark.parametrize(("window", "tolerance", "step"), [(15, 2, None), (15, 2, 1), (16, 1, 3), (12, 0, 4), (9, 2, 2)])
def test_equal_to_brute_force_over_all_windows(spark, tmp_path, window, tolerance, step):
    rng = np.random.default_rng(window * 10 + tolerance)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (230, window - 1, window, 41)]
    texts += ["", None, "A" * 60, "é" * 3 + "".join(rng.choice(list("ACGT"), 40)), texts[0][20:90]]  # hot, wide and repeated ones
    every = [s[i : i + window] for s in texts if s is not None for i in range(len(s) - window + 1)]
    reads = [edited(w, rng, tolerance + 1) for w in every[::9]] + ["", "A", every[0], every[0], None]
    contigs, path = placed(spark, texts, window), str(tmp_path / "t")
    seed_table.save(contigs, path, window, tolerance, step, buckets=3, piece=2 * window)
    table = seed_table.load(spark, path)
    assert table.step - 1 + (tolerance + 1) * table.block <= window and table.block % table.step == 0
    df = reads_of(spark, reads)
    for t, both in ((tolerance, True), (0, False)):
        out = seed_table.search(df, table, t, both)
        want = expected(every, [r or "" for r in reads], t, both, lambda texts, q, t: brute(texts, q, t) if q else [])
        assert out.count() == len(want) and found(out) == want and want
    starts = {r.sequence_id: (r.contig, r.start) for r in windows(contigs, window).collect()}
    assert all(starts[r.sequence_id] == (r.contig, r.start) for r in out.collect())


def test_later_searches_do_not_read_the_reference(spark, tmp_path):
    text = "".join(np.random.default_rng(2).choice(list("ACGT"), 300))
    placed(spark, [text], 30).write.parquet(str(tmp_path / "contigs"))
    seed_table.save(spark.read.parquet(str(tmp_path / "contigs")), str(tmp_path / "t"), 30, 2)
    shutil.rmtree(tmp_path / "contigs")
    for at in (3, 100):
        read = text[at : at + 9] + text[at + 10 : at + 30]
        assert (0, at, "+", 1) in found(seed_table.search(reads_of(spark, [read]), seed_table.load(spark, str(tmp_path / "t"))))


def test_one_row_for_a_step_of_letters(spark, tmp_path):
    assert seed_table.layout(50, 2) == (7, 14) and seed_table.layout(150, 5) == (11, 22) and seed_table.layout(50, 2, 1) == (1, 16)
    seed_table.save(placed(spark, ["ACGTTGCA" * 200], 50), str(tmp_path / "t"), 50, 2, piece=100)
    table = seed_table.load(spark, str(tmp_path / "t"))
    assert sorted(r.place for r in table.blocks.collect()) == list(range(0, 1600 - 13, 7))


def test_empty_tables_and_errors(spark, tmp_path):
    seed_table.save(placed(spark, ["ACG", ""], 10), str(tmp_path / "t"), 10, 1)
    table = seed_table.load(spark, str(tmp_path / "t"))
    assert seed_table.search(reads_of(spark, ["ACGTACGTAC"]), table).count() == 0
    assert seed_table.search(reads_of(spark, ["A"]).limit(0), table).count() == 0
    with pytest.raises(ValueError):
        seed_table.search(reads_of(spark, ["A"]), table, 2)
    for wrong in ((2, 2, None), (10, 1, 9), (10, 1, 0)):
        with pytest.raises(ValueError):
            seed_table.layout(*wrong)
