"""Fill-in-the-middle against a plain version, and the exact text back from the output."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seqspan.llm import fim

DOC = "doc_id long, text string, n string, k1 int, lengths int"


def plain(doc_id, text, seed=42, percent=50, spm_percent=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], DOC).repartition(3)
    out = fim.transformed(df, **options)
    assert out.columns == ["doc_id", "text", "k1", "lengths", *fim.ADDED]
    back = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == (r.text or "") and (r.k1, r.lengths) == (1, 2) for r in back)
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back]
    assert sorted(got, key=repr) == sorted(((i, t, *plain(i, t, **options)) for i, t in rows), key=repr)
    return {r.form for r in back}


def test_fim_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert check(spark, [tuple(r) for r in docs]) == {"plain", "psm", "spm"}


def test_fim_odd_rows(spark):
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "a  b c d", "\U0001f600 éé x\U0001f600y  ", "<P> inside", "x<S>y", "<M>", "<", "<S", "S> <P M>", "<<P", "\x0b\x0c\r", "é " * 5]
    rows = [(k, t) for k in range(12) for t in texts] + [(None, t) for t in texts]
    rows += [(3, "same text here")] * 200 + [(None, "5 a b"), (5, "a b"), (5, None)]  # a third are one row
    assert check(spark, rows, percent=90, spm_percent=50) == {"plain", "psm", "spm"}
    assert check(spark, rows, seed=7) >= {"plain", "spm"}
    assert check(spark, rows, percent=0) == {"plain"}
    assert fim.transformed(spark.createDataFrame([], DOC)).count() == 0


def test_fim_of_a_very_long_text(spark):
    text = " ".join(f"w{k % 977}" for k in range(2_800_000))  # 14 MB
    assert len(text) > 12_000_000
    check(spark, [(k, text) for k in range(2)], percent=100)


@pytest.mark.parametrize("name", ["my.id", "my id"])
def test_fim_names_with_dots_and_string_ids(spark, name):
    df = spark.createDataFrame([(f"d{k}", f"some words of {k} text") for k in range(40)], f"`{name}` string, text string")
    out = fim.transformed(df, id_col=name).collect()
    assert {r[name]: tuple(r[2:]) for r in out} == {f"d{k}": plain(f"d{k}", f"some words of {k} text") for k in range(40)}
