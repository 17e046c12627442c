"""Pipeline stages on odd rows: clashing and dotted names, null and repeated ids, long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from seqspan.llm import jaccard, mixing, simhash

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "predicted", "_gone", "gone", "key", "_key", "cut", "dk", "at", "copy", "n_lines", "deleted_lines", "size", "h", "passes", "upto", "node", "root", "a.b", "x`y"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    long_ = " ".join(f"w{k % 977}" for k in range(60_000))
    same = " ".join(f"same{k}" for k in range(30))
    rows = [
        (1, same, "en", "s1", 1), (1, same, "en", "s1", 1), (1, " ".join(f"other{k}" for k in range(30)), "en", "s1", 1), (None, same, "en", None, 3),
        (None, long_, "en", None, 3), (None, long_, None, None, None), (2, None, None, None, None), (3, "", "en", "s2", 0), (4, " \n\t ", "en", "s2", 4),
        (5, same.upper(), "en", "s1", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_their_columns(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    for r in out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in CLASHING]).distinct().collect():
        assert list(r) == list(range(len(CLASHING)))
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0


def test_packing_stage_takes_odd_rows(spark, odd):
    out = STAGES["packing"](spark, odd, SF).collect()
    assert sum(r.length for r in out) == 30 * 5 + 2 * 60_000 and {r.doc_id for r in out} == {1, 2, 3, 4, 5, None}


@pytest.mark.parametrize("keep", [simhash.keep_one, jaccard.keep_one])
def test_one_row_of_each_group_stays(odd, keep):
    out = Counter((r.doc_id, (r.text or "")[:5].lower()) for r in keep(odd, width=5).collect())
    # rows of one id and unlike texts are documents of their own; null ids are deduplicated
    # among themselves and after others; texts without words are alike
    assert out == Counter({(1, "same0"): 1, (1, "other"): 1, (None, "w0 w1"): 1, (2, ""): 1})


def test_line_dedup_stage_follows_the_text(spark):
    passage = "\n".join(" ".join(f"p{k}x{j}" for j in range(11)) for k in range(2))
    df = spark.createDataFrame([(1, f"start\n{passage}", "en", "s", 7), (2, f"{passage}\nend", "en", "s", 8), (3, "own", "en", "s", 9)], DOC)
    out = {r.doc_id: (r.text, r.n_chars) for r in STAGES["line_dedup"](spark, df, SF).collect()}
    assert out == {1: (f"start\n{passage}", 7), 2: ("end", 3), 3: ("own", 9)}


def test_mix_repeats_whole_rows(spark, odd):
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    got = Counter(r.doc_id for r in mixing.mixed_documents(odd).collect())
    assert +got == +want and sum(got.values()) > 0


def test_run_gives_what_the_stages_give_one_by_one(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        df = spark.createDataFrame(df.toArrow(), T.StructType(df.schema.fields)) if df.columns[0] == "doc_id" else df
    got = Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, r.piece, r.length) for r in df.collect())
