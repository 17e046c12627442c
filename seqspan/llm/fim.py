"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit boundaries.

A text is cut into units, words with the white space before them (``UNIT``).  The relational
form: unit lengths are exploded with their ordinals, a window sums them up within a document,
the two cut requests of a document meet the sums by unit ordinal, and their offsets are
aggregated to one row a document, by which its text is cut with ``substring``.

Only documents that are rearranged take this way, and of them only the units up to the second
cut.  Equal rows (id and text) have equal cuts, so they send one list of lengths between them;
the texts are shuffled once, in the join with the offsets.  A list holds a number for each
unit of one text, as the row holds the text.

Whether and how a document is rearranged is drawn from the SHA-256 of the seed and its id
(``draws``).  Nulls: a null text is empty, a null id counts as the empty id text.  Empty texts
and texts that hold a marker stay plain.  Repeated rows get equal results, each its own row.
Columns named like the results are replaced, others pass.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqspan.llm.common import columns_of, fresh, row_key, spare, spread_join, stored, work_dir

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_lengths(text: Column) -> Column:
    """Code points of each unit; units cover the whole text."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.length)


def draws(id_: Column, seed: int = 42) -> list[Column]:
    """Four numbers below 2**32: the first digit groups of the hex SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form_of(id_: Column, text: Column, seed: int, percent: int, spm_percent: int) -> Column:
    h = draws(id_, seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h[2] % 100 >= percent)
    return F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")


def cut_offsets(units: DataFrame) -> DataFrame:
    """``units(k1, k2, n, first, last, lengths)``, one row a key -> ``(k1, k2, n, prefix_chars,
    middle_end)`` in code points.  Lengths go up to unit ``last``; a unit of length 0 stands
    before the first one, so that every cut meets one.

    Sums and cuts stay where the key put them: the ordinal is no key of the join."""
    key = ["k1", "k2"]
    each = units.repartition(*key).select(*key, F.posexplode("lengths").alias("ordinal", "length"))
    upto = F.sum("length").over(W.partitionBy(*key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0))
    ends = each.select(*key, "ordinal", upto.alias("end"))
    cuts = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("wanted")) for c in ("first", "last")])
    cuts = units.select(*key, "n", F.explode(cuts).alias("x")).repartition(*key).select(*key, "n", "x.*")
    met = ends.join(cuts.hint("merge"), key).where((F.col("ordinal") >= F.col("wanted")) & (F.col("ordinal") <= F.col("wanted")))
    at = lambda cut: F.max(F.when(F.col("cut") == cut, F.col("end")))
    return met.groupBy(*key).agg(F.first("n").alias("n"), at("first").alias("prefix_chars"), at("last").alias("middle_end"))


def transformed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``docs`` with n (units), form (plain, psm, spm), prefix_chars and middle_chars (null if
    plain) and output, the text in its form; about ``percent`` of 100 documents are rearranged,
    ``spm_percent`` of 100 of these suffix first."""
    docs = fresh(docs, list(ADDED))
    folder = work_dir(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = columns_of(docs)
    form = form_of(id_, text, seed, percent, spm_percent)
    none = F.lit(None).cast("long")
    plain = docs.where(form == "plain").select(
        *names, F.size(unit_lengths(text)).cast("long").alias("n"), form.alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), text.alias("output"))

    h = draws(id_, seed)
    k1, k2 = row_key(id_, F.col(f"`{text_col}`"))
    moved = docs.where(form != "plain")
    lengths = moved.select(k1.alias("k1"), k2.alias("k2"), h[0].alias("h1"), h[1].alias("h2"), unit_lengths(text).alias("lengths"))
    n = F.size("lengths")
    cuts = [F.col(c) % (n + 1) for c in ("h1", "h2")]
    lengths = lengths.withColumns({"n": n.cast("long"), "first": F.least(*cuts), "last": F.greatest(*cuts)})
    upto = F.concat(F.array(F.lit(0)), F.slice("lengths", 1, F.col("last").cast("int")))
    units = stored(lengths.select("k1", "k2", "n", "first", "last", upto.alias("lengths")).dropDuplicates(["k1", "k2"]), folder, "units")
    cut = [spare(docs, x) for x in ("k1", "k2", "n", "prefix_chars", "middle_end")]
    offsets = stored(cut_offsets(units).toDF(*cut), folder, "offsets")
    met = spread_join(moved.withColumns({cut[0]: k1, cut[1]: k2}), offsets, cut[:2])
    start, end = F.col(cut[3]).cast("int"), F.col(cut[4]).cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text))
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    moved = met.select(
        *names, F.col(cut[2]).alias("n"), form.alias("form"), F.col(cut[3]).alias("prefix_chars"), (F.col(cut[4]) - F.col(cut[3])).alias("middle_chars"),
        F.when(form == "spm", spm).otherwise(psm).alias("output"))
    return plain.unionByName(moved)


def restored(output: Column, form: Column) -> Column:
    """The text behind ``output``, from it and its form alone: no piece holds a marker, and none
    can arise where a piece and a marker meet."""
    middle_at = F.locate(MIDDLE, output)
    middle = F.substring(output, middle_at + 3, F.length(output))

    def pieces(second: str) -> tuple[Column, Column]:
        at = F.locate(second, output)
        return F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, middle_at - at - 3)

    (prefix, suffix), (suffix_first, prefix_last) = pieces(SUFFIX), pieces(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_last, middle, suffix_first))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = transformed(docs)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = ["('0x' || substr(h, {}, 8))::BIGINT".format(8 * k + 1) for k in range(4)]
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) AS a, greatest({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H[2]} % 100 >= 50 THEN 'plain'
       WHEN {_H[3]} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p"""
