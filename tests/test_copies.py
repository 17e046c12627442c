"""Members with many copies: levels hold texts, leaves and answers hold every copy."""

import random

from seqspan.config import BuildConfig, QueryConfig
from seqspan.operators import hierarchy, search
from tests.plain import Tree, dp
from tests.test_index import check_tree, expected, found, reads_of

TEXTS = ["AAAAAAAA", "AAAAAAAC", "AAAAAACC", "ACGTACGT", "ACGTACGA", "TTTTTTTT", "TTTTTTTA", "GGGGAAAA"]


def test_levels_hold_a_row_for_each_text(spark, monkeypatch):
    rng = random.Random(5)
    texts = [TEXTS[min(int(rng.expovariate(0.5)), 6)] for _ in range(400)] + TEXTS[7:]  # the last one once
    rows = [(k, f"c{k}", 0, s) for k, s in enumerate(texts)]
    every = spark.createDataFrame(rows, "sequence_id long, contig string, start long, seq string")
    stored, store = {}, hierarchy.kept

    def kept(df, folder, name):
        out = store(df, folder, name)
        stored[name] = out.count() if name.endswith("_members") or name == "members" else 0
        return out

    monkeypatch.setattr(hierarchy, "kept", kept)
    monkeypatch.setattr("seqspan.operators.scan.BLOCK", 5)  # leaves are ordered by blocks of 32 ids
    radii, ratios = (3, 3, 3), (0.5, 0.5, 0.5)
    index = hierarchy.build_from_windows(every, 8, 1, BuildConfig(radii, ratios, 1))
    assert "members" not in stored  # nothing asked for leaves
    assert max(stored[f"{name}_members"] for name in ("large", "middle", "small")) < 60
    check_tree(index, Tree(texts, radii, ratios, 1))
    assert stored["members"] > 400
    reads = ["AAAAAAAG", "ACGTACG", "TTTTTTTT", "GGGG"]
    hits = search.routed(reads_of(spark, reads), index, QueryConfig(both_strands=True))
    assert found(hits) == expected(texts, reads, 1, True)


def test_near_texts_are_all_pairs_whatever_the_lengths(spark):
    rng = random.Random(7)
    texts = sorted({"".join(rng.choice("AC") for _ in range(n)) for n in [8] * 40 + [0, 1, 5, 9, 20]})
    reads = sorted({"".join(rng.choice("AC") for _ in range(n)) for n in (0, 3, 6, 7, 7, 8, 8, 8, 9, 10)})
    asked, held = spark.createDataFrame([(x,) for x in reads], "seq string"), spark.createDataFrame([(x,) for x in texts], "s string")
    for window, t in ((8, 0), (8, 2), (0, 1)):
        want = sorted((q, s, d) for q in reads for s in texts if (d := dp(q, s)) <= t)
        assert sorted(tuple(r) for r in search.near_texts(asked, held, window, t).collect()) == want
