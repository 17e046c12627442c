"""Queries of the similarity engine over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.config import QueryConfig
from seqspan.functions import sequences as fn
from seqspan.operators import hierarchy, inspection, search, seed_table
from seqspan.operators.centers import center_edit_calls
from seqspan.operators.hierarchy import SequenceIndex
from seqspan.operators.reads import generate_reads
from seqspan.operators.scan import places
from seqspan.operators.seeds import seed_hits
from seqspan.operators.tables import kept, work_folder
from seqspan.operators.windows import locations, windows
from seqspan.plans import corpus
from seqspan.sources import fasta, hits, index_file, index_store

Query = Callable[[SparkSession, str], DataFrame]
T = corpus.PART_CONFIG.max_tolerance


def clean_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ascii_text = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    return docs.select("doc_id", fn.clean(ascii_text).alias("bases"))


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_contigs(spark, sf_dir).select("contig_ordinal", fn.reverse_complement(F.col("bases")).alias("reversed"))


def contig_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_contigs(spark, sf_dir).select("contig_ordinal", "name")


def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = corpus.contig_windows(corpus.document_contigs(spark, sf_dir), corpus.WINDOW, corpus.STRIDE)
    return contigs.select("contig_ordinal", "window_count", "first_sequence_id")


def window_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_windows(spark, sf_dir)


def window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of 1000 windows is the feature: the last contig is clipped."""
    contigs = corpus.contig_windows(corpus.document_contigs(spark, sf_dir), corpus.WINDOW, corpus.STRIDE, 1000)
    return contigs.select("contig_ordinal", "window_count", "first_sequence_id")


def location_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig and start of one id of each contig: its middle window."""
    contigs = kept(corpus.contig_windows(corpus.document_contigs(spark, sf_dir), corpus.WINDOW, corpus.STRIDE).drop("bases"), work_folder(spark), "contigs")
    ids = contigs.where("window_count > 0").select((F.col("first_sequence_id") + F.floor(F.col("window_count") / 2)).alias("sequence_id"))
    return locations(ids, contigs, corpus.STRIDE).select("sequence_id", "contig", "start")


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fn.clean(F.col("p_name")).alias("a"))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", fn.clean(F.col("n_name")).alias("b"))
    return parts.crossJoin(names)  # 25 nations at any scale


def distance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("p_partkey", "n_nationkey", fn.distance(F.col("a"), F.col("b")).alias("distance"))


def distance_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("p_partkey", "n_nationkey", fn.bounded_distance(F.col("a"), F.col("b"), 11).alias("distance"))


def brute_force_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.brute_force(corpus.part_reads(spark, sf_dir), corpus.part_windows(spark, sf_dir), 2)


def both_strand_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.brute_force(corpus.part_reads(spark, sf_dir), corpus.part_windows(spark, sf_dir), 3, True)


def segment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_segments(corpus.benchmark_reads(spark, sf_dir), corpus.document_windows(spark, sf_dir), corpus.WINDOW, corpus.TOLERANCE)


def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark pieces among all document windows at stride 1."""
    contigs = corpus.contig_windows(corpus.document_contigs(spark, sf_dir), corpus.WINDOW, 1)
    return seed_hits(corpus.benchmark_reads(spark, sf_dir), contigs, corpus.WINDOW, corpus.CLOSE)


def seed_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by a stored table of the documents' blocks."""
    contigs, path = corpus.contig_windows(corpus.document_contigs(spark, sf_dir), corpus.WINDOW, 1), f"{work_folder(spark)}/seeds"
    seed_table.save(contigs, path, corpus.WINDOW, corpus.CLOSE)
    return seed_table.search(corpus.benchmark_reads(spark, sf_dir), seed_table.load(spark, path))


def passage_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh build of the index of the passages: its worlds and their centers at the root."""
    nodes = corpus.build_passages(spark, sf_dir).nodes.where("layer = 0")
    return nodes.select("child_ordinal", "center_sequence_id", "center_seq")


def passage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.routed(corpus.passage_reads(spark, sf_dir), corpus.passage_index(spark, sf_dir), QueryConfig(both_strands=True))


def passage_hits_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.routed(corpus.passage_reads(spark, sf_dir), corpus.passage_index(spark, sf_dir), QueryConfig(both_strands=True, route="scan"))


def passage_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, windows = corpus.passage_reads(spark, sf_dir), corpus.passage_windows(spark, sf_dir)
    return search.verify(reads, corpus.passage_index(spark, sf_dir), windows, QueryConfig(both_strands=True), limit=0)


def default_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window 150, stride 1, T 5, radii 60, 35, 15: what the command line does by default."""
    return search.routed(corpus.default_reads(spark, sf_dir), corpus.default_index(spark, sf_dir), QueryConfig(both_strands=True))


def default_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, windows = corpus.default_reads(spark, sf_dir), corpus.default_windows(spark, sf_dir)
    return search.verify(reads, corpus.default_index(spark, sf_dir), windows, QueryConfig(both_strands=True), limit=0)


def _file(spark: SparkSession, df: DataFrame, name: str, write: Callable[[DataFrame, str], None]) -> str:
    path = f"{work_folder(spark)}/{name}"
    write(df, path)
    return path


def fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FASTA with a longer header, and read as a reference."""
    docs = corpus.document_contigs(spark, sf_dir)
    lines = F.regexp_replace("bases", "(.{60})", "$1\n")  # bases in lines of 60
    path = _file(spark, docs.select(F.col("contig_ordinal").alias("ordinal"), F.concat("name", F.lit(" more words")).alias("name"), lines.alias("seq")), "r.fa", hits.write_fasta)
    return fasta.read_contigs(spark, path)


def fasta_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark pieces written as FASTA and read as reads: the whole header is the name."""
    reads = corpus.benchmark_reads(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" tail")))
    return fasta.read_reads(spark, _file(spark, reads, "q.fa", hits.write_fasta))


def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as FASTQ; the format is found from the first character."""
    return fasta.read_reads(spark, _file(spark, corpus.benchmark_reads(spark, sf_dir), "q.fq", hits.write_fastq))


def read_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of 20 reads is the feature."""
    return fasta.read_reads(spark, _file(spark, corpus.benchmark_reads(spark, sf_dir), "q.fq", hits.write_fastq), limit=20)


def in_memory_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names of one length as an in-memory source: 25 rows at any scale."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select(F.rpad("n_name", 12, "n")).collect()
    contigs, window, stride = fasta.from_sequences(spark, [r[0] for r in names])
    return windows(fasta.contig_windows(contigs, window, stride), window, stride)


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, index_hits(spark, sf_dir), "hits", hits.write_tsv)
    return hits.read_tsv(spark, path)


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf members of the saved and loaded index."""
    path = f"{work_folder(spark)}/index"
    index_store.save(corpus.part_index(spark, sf_dir), path)
    return index_store.load(spark, path).members.select("leaf_id", "member_ordinal", "sequence_id")


def _index_file(spark: SparkSession, sf_dir: str) -> SequenceIndex:
    """The index of all part names, written as a binary file and read again."""
    path = f"{work_folder(spark)}/binary"
    index_file.save(corpus.part_index(spark, sf_dir), path)
    one = F.lit(1).cast("long")
    contigs = corpus.part_windows(spark, sf_dir).select(F.col("contig").alias("name"), F.col("sequence_id").alias("first_sequence_id"), one.alias("window_count"))
    return index_file.load(spark, path, contigs)


def index_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf members of the binary file."""
    return _index_file(spark, sf_dir).members.select("leaf_id", "member_ordinal", "sequence_id", "seq", "contig")


def index_file_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beacons and distances of their centers, from the binary file."""
    index = _index_file(spark, sf_dir)
    beacons = index.beacons.select("parent_id", "beacon_index", F.col("child_ordinal").alias("beacon_ordinal"))
    return index.beacon_distances.join(beacons, ["parent_id", "beacon_index"])


def index_file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of ``index_hits`` in the index of the binary file."""
    return search.routed(corpus.part_reads(spark, sf_dir), _index_file(spark, sf_dir), QueryConfig(both_strands=True))


def index_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.size_in_memory(corpus.part_index(spark, sf_dir))


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows below each large world, whatever the leaves that hold them."""
    index = corpus.part_index(spark, sf_dir)
    small = index.nodes.where("layer = 2").select(F.col("node_id").alias("leaf_id"), F.col("parent_id").alias("middle"))
    middle = index.nodes.where("layer = 1").select(F.col("node_id").alias("middle"), F.col("parent_id").alias("large"))
    return index.members.join(small, "leaf_id").join(middle, "middle").select(F.col("large").alias("node_id"), "sequence_id").distinct()


def hits_tsv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("query", "contig", "start", "distance", "strand", "sequence_id")])
    return index_hits(spark, sf_dir).select(line.alias("line"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.part_windows(spark, sf_dir).select(F.lit(0).cast("long").alias("parent"), F.col("sequence_id").alias("id"), F.col("seq").alias("s"))


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers of the root, from the index."""
    nodes = corpus.part_index(spark, sf_dir).nodes.where("layer = 0")
    return nodes.select(F.col("parent_id").alias("parent"), "child_ordinal", F.col("center_sequence_id").alias("center_id"), F.col("center_seq").alias("center_s"))


def greedy_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.choose_centers(_members(spark, sf_dir), corpus.PART_CONFIG.radii[0], work_folder(spark), "root").select("child_ordinal", "center_id", "center_s")


def center_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return center_edit_calls(_members(spark, sf_dir), _centers(spark, sf_dir), corpus.PART_CONFIG.radii[0])


def beacon_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.part_index(spark, sf_dir).beacons.where("parent_id = 0").select("beacon_index", "child_ordinal")


def beacon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.part_index(spark, sf_dir).beacon_distances.select("parent_id", "child_ordinal", "beacon_index", "distance")


def lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangle bound of every read to every large center."""
    index = corpus.part_index(spark, sf_dir)
    table = index.beacon_distances.where("parent_id = 0").select("child_ordinal", "beacon_index", "distance")
    chosen = index.beacons.where("parent_id = 0").select("beacon_index", "child_ordinal").join(_centers(spark, sf_dir), "child_ordinal").select("beacon_index", "center_s")
    to_beacon = corpus.part_reads(spark, sf_dir).crossJoin(chosen).select("ordinal", "beacon_index", F.levenshtein("seq", "center_s").alias("to_beacon"))
    return to_beacon.join(table, "beacon_index").groupBy("ordinal", "child_ordinal").agg(fn.triangle_bound(F.col("to_beacon"), F.col("distance")).alias("lower_bound"))


def classify_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, centers = corpus.part_index(spark, sf_dir), _centers(spark, sf_dir)
    root = lambda df: df.where("parent_id = 0").withColumnRenamed("parent_id", "parent")
    marked = hierarchy.marked_members(_members(spark, sf_dir), centers)
    folder = work_folder(spark)
    distances = hierarchy.text_distances(marked, centers, root(index.beacons), root(index.beacon_distances), T, folder, "root")
    found = hierarchy.classify(marked, centers, kept(distances, folder, "distances"))
    return found.select("child_ordinal", "id", F.col("d").alias("distance"))


def world_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.part_index(spark, sf_dir).nodes.select("node_id", "layer", "member_count", "child_count", "beacon_count")


def pruning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["build_layer", "center_edit_calls", "beacon_table_edit_calls", "member_beacon_edit_calls", "candidate_edit_calls", "classification_center_pairs", "pruned_center_pairs", "classified_members", "pruning_ratio"]
    return corpus.part_index(spark, sf_dir).build_stats.select(keep)


def route_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.strands(corpus.part_reads(spark, sf_dir), True).withColumn("parent", F.lit(0).cast("long"))
    return search.route_level(asked, corpus.part_index(spark, sf_dir).nodes.where("layer = 0"), work_folder(spark), "root").select("ordinal", "reverse", F.col("parent").alias("node_id"))


def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.part_index(spark, sf_dir).nodes.select("node_id", "layer", "parent_id", "child_ordinal", "center_sequence_id", "center_seq")


def leaf_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.part_index(spark, sf_dir).members.select("leaf_id", "member_ordinal", "sequence_id")


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.summary(corpus.part_index(spark, sf_dir))


def index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.routed(corpus.part_reads(spark, sf_dir), corpus.part_index(spark, sf_dir), QueryConfig(both_strands=True))


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.verify(corpus.part_reads(spark, sf_dir), corpus.part_index(spark, sf_dir), corpus.part_windows(spark, sf_dir), QueryConfig(both_strands=True), limit=0)


def hit_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(index_hits(spark, sf_dir).select("ordinal", "sequence_id", "strand", "distance"), work_folder(spark), "hits")
    placed = places(found, "ordinal", "sequence_id", [F.when(F.col("strand") == "+", 0).otherwise(1), F.col("distance")], "place")
    return placed.select("ordinal", "sequence_id", "strand", (F.col("place") + 1).cast("int").alias("place"))


def query_stats_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.part_index(spark, sf_dir)
    return search.query_stats(corpus.part_reads(spark, sf_dir), index, QueryConfig(route="scan")).select("routing_edit_calls", "leaf_members", "exact_verifications", "total_edit_calls")


def query_stats_multilateration(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = search.query_stats(corpus.part_reads(spark, sf_dir), corpus.part_index(spark, sf_dir))
    counts = [f"{c}_{k}" for c in ("edits", "pruned") for k in range(3)]
    return stats.select(*counts, F.col("leaf_members").alias("leaf"), "routing_edit_calls", "leaf_members", "exact_verifications", "total_edit_calls")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.latency_report(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


def generated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = corpus.document_windows(spark, sf_dir)
    return generate_reads(source, window=corpus.WINDOW)


def queries() -> dict[str, Query]:
    named = [
        clean_sequences, reverse_complement, contig_names, window_ids, window_extract, window_limit, location_lookup, distance_exact,
        distance_bounded, brute_force_hits, both_strand_hits, segment_hits, hits_tsv_projection, greedy_centers, beacon_ordinals,
        beacon_table, lower_bounds, classify_members, world_sizes, pruning_stats, route_nearest, hierarchy_nodes, leaf_members,
        index_summary, index_hits, verify_counts, hit_order_rank, query_stats_scan, query_stats_multilateration, latency_percentiles,
        generated_reads, dense_hits, seed_table_hits, passage_build, passage_hits, passage_hits_scan, passage_verify, default_hits, default_verify, fasta_contigs, fasta_reads, fastq_reads,
        read_limit, in_memory_windows, tsv_round_trip, index_round_trip, index_file_round_trip, index_file_beacons, index_file_hits, index_bytes, descendants,
    ]
    return {f.__name__: f for f in named} | {"center_edit_calls": center_calls}


# ---------------------------------------------------------------- SQL

_FOLD = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
_CONTIGS = f"""
k AS (SELECT doc_id AS contig_ordinal, 'doc_' || doc_id AS name, {_FOLD} AS bases FROM documents),
kc AS (SELECT *, CASE WHEN length(bases) >= 50 THEN (length(bases) - 50) // 50 + 1 ELSE 0 END::BIGINT AS n FROM k),
kw AS (SELECT *, coalesce(sum(n) OVER (ORDER BY contig_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id FROM kc),
dw AS (SELECT first_id + i AS sequence_id, name AS contig, i * 50 AS start, substr(bases, (i * 50 + 1)::BIGINT, 50) AS seq
       FROM (SELECT *, unnest(range(n)) AS i FROM kw WHERE n > 0))"""
_CLEAN = "upper(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))"
_RC = "translate(reverse(upper({})), 'ACGT', 'TGCA')"
_PARTS = f"""
w AS MATERIALIZED (SELECT p_partkey AS id, {_CLEAN.format('p_name')} AS s FROM part),
rd AS MATERIALIZED (SELECT ordinal, 'r' || ordinal AS name, substr(s, 1, pos) || substr(s, pos + 2) AS seq
  FROM (SELECT min(id) AS ordinal, s, (CASE WHEN length(s) > 0 THEN min(id) % length(s) ELSE 0 END)::BIGINT AS pos FROM w GROUP BY s))"""
_R, _B = corpus.PART_CONFIG.radii, corpus.PART_CONFIG.beacon_ratios


def _greedy(k: int, members: str, radius: int) -> str:
    near = f"len(list_filter(g.cs, lambda c: levenshtein(c, r.s) <= {radius})) = 0"
    return f"""
d{k} AS MATERIALIZED (SELECT parent, s, min(id) AS id FROM {members} GROUP BY ALL),
r{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY id) AS rn FROM d{k}),
g{k}(parent, rn, ids, cs) AS (
  SELECT parent, rn, [id], [s] FROM r{k} WHERE rn = 1
  UNION ALL
  SELECT g.parent, r.rn, CASE WHEN {near} THEN list_append(g.ids, r.id) ELSE g.ids END, CASE WHEN {near} THEN list_append(g.cs, r.s) ELSE g.cs END
  FROM g{k} g JOIN r{k} r ON r.parent = g.parent AND r.rn = g.rn + 1),
e{k} AS (SELECT parent, arg_max(ids, rn) AS ids, arg_max(cs, rn) AS cs FROM g{k} GROUP BY parent),
c{k} AS MATERIALIZED (SELECT parent, unnest(ids) AS center_id, unnest(cs) AS center_s, unnest(range(len(ids))) AS child_ordinal FROM e{k})"""


def _level(k: int, members: str) -> str:
    first = "1" + "".join(f" + (SELECT count(*) FROM c{j})" for j in range(k))
    return _greedy(k, members, _R[k]) + f""",
n{k} AS MATERIALIZED (SELECT *, (row_number() OVER (ORDER BY parent, child_ordinal) - 1 + {first})::BIGINT AS node_id FROM c{k}),
p{k} AS MATERIALIZED (SELECT m.parent, m.id, m.s, n.node_id, n.child_ordinal, n.center_id, levenshtein(m.s, n.center_s) AS d,
   min(levenshtein(m.s, n.center_s)) OVER (PARTITION BY m.parent, m.id) AS nearest,
   bool_or(m.id = n.center_id) OVER (PARTITION BY m.parent, m.id) AS is_center FROM {members} m JOIN n{k} n ON m.parent = n.parent),
m{k + 1} AS MATERIALIZED (SELECT node_id AS parent, id, s, child_ordinal, d FROM p{k}
   WHERE (is_center AND id = center_id) OR (NOT is_center AND d <= nearest + {2 * T})),
b{k} AS MATERIALIZED (SELECT parent, i AS beacon_index, (i * n) // k AS child_ordinal FROM (
   SELECT parent, n, k, unnest(range(k)) AS i FROM (SELECT parent, count(*) AS n, ceil({_B[k]}::DOUBLE * count(*))::BIGINT AS k FROM c{k} GROUP BY parent))),
t{k} AS MATERIALIZED (SELECT c.parent, c.child_ordinal, b.beacon_index, levenshtein(c.center_s, x.center_s) AS distance
   FROM c{k} c JOIN b{k} b USING (parent) JOIN c{k} x ON x.parent = b.parent AND x.child_ordinal = b.child_ordinal)"""


def _tree(levels: int, select: str) -> str:
    parts = [_PARTS, "\nm0 AS MATERIALIZED (SELECT 0::BIGINT AS parent, id, s FROM w)"]
    parts += [_level(k, f"m{k}") for k in range(levels)]
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def _near(tolerance: int, both: bool) -> str:
    rc = f" UNION ALL SELECT ordinal, name, {_RC.format('seq')}, '-' FROM rd" if both else ""
    return f"""WITH {_PARTS},
q AS (SELECT ordinal, name, seq, '+' AS strand FROM rd{rc}),
x AS (SELECT q.*, u.s, levenshtein(q.seq, u.s)::INTEGER AS distance FROM q, (SELECT DISTINCT s FROM w) u),
h AS (SELECT ordinal, name AS query, 'part_' || id AS contig, 0::BIGINT AS start, distance, strand, id AS sequence_id FROM x JOIN w USING (s) WHERE distance <= {tolerance})
"""


def _stats_level(k: int) -> str:
    return f"""SELECT '{("large", "middle", "small")[k]}' AS build_layer,
 (SELECT sum(calls) FROM (SELECT child_ordinal AS calls FROM c{k} UNION ALL
    SELECT min(n.child_ordinal) + 1 FROM m{k} m JOIN c{k} n ON m.parent = n.parent AND levenshtein(m.s, n.center_s) <= {_R[k]}
    WHERE NOT EXISTS (SELECT 1 FROM c{k} z WHERE z.parent = m.parent AND z.center_id = m.id) GROUP BY m.parent, m.id))::BIGINT AS center_edit_calls,
 (SELECT count(*) FROM t{k}) AS beacon_table_edit_calls, mb AS member_beacon_edit_calls, pairs - mb - pruned AS candidate_edit_calls,
 pairs AS classification_center_pairs, pruned AS pruned_center_pairs, classified AS classified_members,
 CASE WHEN pairs = 0 THEN 0.0::DOUBLE ELSE pruned::DOUBLE / pairs END AS pruning_ratio
FROM (SELECT count(*) AS pairs, count(b.beacon_index) AS mb, count(DISTINCT (p.parent, p.id)) AS classified
      FROM p{k} p LEFT JOIN b{k} b USING (parent, child_ordinal) WHERE NOT p.is_center),
     (SELECT count(*) AS pruned FROM (
        SELECT p.parent, p.id, p.child_ordinal, max(abs(y.d - t.distance)) AS lower, min(y.d) AS upper
        FROM p{k} p JOIN t{k} t USING (parent, child_ordinal) JOIN b{k} b ON b.parent = p.parent AND b.beacon_index = t.beacon_index
        JOIN p{k} y ON y.parent = p.parent AND y.id = p.id AND y.child_ordinal = b.child_ordinal
        WHERE NOT p.is_center AND NOT EXISTS (SELECT 1 FROM b{k} z WHERE z.parent = p.parent AND z.child_ordinal = p.child_ordinal)
        GROUP BY ALL) WHERE lower > upper + {2 * T})"""


_PASSAGES = f"""
bc AS (SELECT item_id, 'item_' || item_id AS name, {_FOLD} AS bases FROM benchmark),
bn AS (SELECT *, CASE WHEN length(bases) >= 50 THEN (length(bases) - 50) // 5 + 1 ELSE 0 END::BIGINT AS n5,
              CASE WHEN length(bases) >= 50 THEN (length(bases) - 50) // 10 + 1 ELSE 0 END::BIGINT AS n10 FROM bc),
bf AS (SELECT *, coalesce(sum(n5) OVER r, 0)::BIGINT AS f5, coalesce(sum(n10) OVER r, 0)::BIGINT AS f10 FROM bn
       WINDOW r AS (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pw AS MATERIALIZED (SELECT f5 + i AS id, name AS contig, i * 5 AS start, substr(bases, (i * 5 + 1)::BIGINT, 50) AS s FROM (SELECT *, unnest(range(n5)) AS i FROM bf WHERE n5 > 0)),
pr AS MATERIALIZED (SELECT id AS ordinal, 'p' || id AS query, substr(s, 1, (id % 49)::BIGINT) || substr(s, (id % 49 + 2)::BIGINT, (48 - id % 49)::BIGINT) || translate(substr(s, 50, 1), 'ACGT', 'CATG') AS seq
  FROM (SELECT f10 + i AS id, substr(bases, (i * 10 + 1)::BIGINT, 50) AS s FROM (SELECT *, unnest(range(n10)) AS i FROM bf WHERE n10 > 0)))"""


def _passage_hits(select: str) -> str:
    return f"""WITH {_PASSAGES},
q AS (SELECT ordinal, query, seq, '+' AS strand FROM pr UNION ALL SELECT ordinal, query, {_RC.format('seq')}, '-' FROM pr),
x AS (SELECT q.*, u.s, levenshtein(q.seq, u.s)::INTEGER AS distance FROM q, (SELECT DISTINCT s FROM pw) u),
h AS (SELECT ordinal, query, contig, start, distance, strand, id AS sequence_id FROM x JOIN pw USING (s) WHERE distance <= {corpus.CLOSE})
{select}"""


def _default_hits(select: str) -> str:
    windows = "CASE WHEN length(bases) >= 150 THEN (length(bases) - 150) // {0} + 1 ELSE 0 END::BIGINT AS n{0}"
    return f"""WITH bc AS (SELECT item_id, 'item_' || item_id AS name, {_FOLD} AS bases FROM benchmark),
bn AS (SELECT *, {windows.format(1)}, {windows.format(10)} FROM bc),
bf AS (SELECT *, coalesce(sum(n1) OVER r, 0)::BIGINT AS f1, coalesce(sum(n10) OVER r, 0)::BIGINT AS f10 FROM bn
       WINDOW r AS (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pw AS MATERIALIZED (SELECT f1 + i AS id, name AS contig, i AS start, substr(bases, (i + 1)::BIGINT, 150) AS s FROM (SELECT *, unnest(range(n1)) AS i FROM bf WHERE n1 > 0)),
pr AS MATERIALIZED (SELECT id AS ordinal, 'p' || id AS query, substr(s, 1, (id % 149)::BIGINT) || substr(s, (id % 149 + 2)::BIGINT, (148 - id % 149)::BIGINT) || translate(substr(s, 150, 1), 'ACGT', 'CATG') AS seq
  FROM (SELECT f10 + i AS id, substr(bases, (i * 10 + 1)::BIGINT, 150) AS s FROM (SELECT *, unnest(range(n10)) AS i FROM bf WHERE n10 > 0))),
q AS (SELECT ordinal, query, seq, '+' AS strand FROM pr UNION ALL SELECT ordinal, query, {_RC.format('seq')}, '-' FROM pr),
x AS (SELECT q.*, u.s, levenshtein(q.seq, u.s)::INTEGER AS distance FROM q, (SELECT DISTINCT s FROM pw) u),
h AS (SELECT ordinal, query, contig, start, distance, strand, id AS sequence_id FROM x JOIN pw USING (s) WHERE distance <= 5)
{select}"""


def _route_stats() -> str:
    """The rule of pruning, child by child, as a recursion over the candidates in order."""
    parts, names = [], ("n0", "n1", "n2")
    for k, n in enumerate(names):
        asked = "(SELECT ordinal, seq, 0::BIGINT AS parent FROM rd)" if k == 0 else f"q{k}"
        parts.append(f"""
v{k} AS MATERIALIZED (SELECT a.ordinal, a.seq, n.parent, n.child_ordinal, n.node_id, levenshtein(a.seq, n.center_s) AS d, b.beacon_index
  FROM {asked} a JOIN {n} n ON n.parent = a.parent LEFT JOIN b{k} b ON b.parent = n.parent AND b.child_ordinal = n.child_ordinal),
f{k} AS MATERIALIZED (SELECT ordinal, arg_min(d, d * 1000000 + node_id) AS d, arg_min(node_id, d * 1000000 + node_id) AS node_id, count(*) AS calls
  FROM v{k} WHERE beacon_index IS NOT NULL OR child_ordinal = 0 GROUP BY ordinal),
l{k} AS (SELECT v.ordinal, v.node_id, v.d, coalesce((SELECT max(abs(x.d - t.distance)) FROM v{k} x JOIN t{k} t ON t.parent = x.parent AND t.beacon_index = x.beacon_index
    WHERE x.ordinal = v.ordinal AND x.beacon_index IS NOT NULL AND t.child_ordinal = v.child_ordinal), 0) AS low
  FROM v{k} v WHERE v.beacon_index IS NULL AND v.child_ordinal <> 0),
o{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY low, node_id) AS rn FROM l{k}),
w{k}(ordinal, rn, d, node_id, calls, pruned) AS (
  SELECT ordinal, 0::BIGINT, d, node_id, calls, 0::BIGINT FROM f{k}
  UNION ALL
  SELECT w.ordinal, o.rn, CASE WHEN cut THEN w.d WHEN (o.d, o.node_id) < (w.d, w.node_id) THEN o.d ELSE w.d END,
         CASE WHEN cut THEN w.node_id WHEN (o.d, o.node_id) < (w.d, w.node_id) THEN o.node_id ELSE w.node_id END,
         w.calls + (CASE WHEN cut THEN 0 ELSE 1 END), w.pruned + (CASE WHEN cut THEN 1 ELSE 0 END)
  FROM (SELECT w.*, o.rn AS orn, o.low > w.d OR (o.low = w.d AND o.node_id >= w.node_id) AS cut FROM w{k} w JOIN o{k} o ON o.ordinal = w.ordinal AND o.rn = w.rn + 1) w
  JOIN o{k} o ON o.ordinal = w.ordinal AND o.rn = w.orn),
z{k} AS MATERIALIZED (SELECT ordinal, arg_max(node_id, rn) AS node_id, max(calls) AS calls, max(pruned) AS pruned FROM w{k} GROUP BY ordinal),
q{k + 1} AS MATERIALIZED (SELECT r.ordinal, r.seq, z.node_id AS parent FROM z{k} z JOIN rd r USING (ordinal))""")
    body = [_PARTS, "\nm0 AS MATERIALIZED (SELECT 0::BIGINT AS parent, id, s FROM w)", *[_level(k, f"m{k}") for k in range(3)], *parts]
    each = ", ".join(f"(SELECT sum({c}) FROM z{k})::BIGINT AS {name}_{k}" for c, name in (("calls", "edits"), ("pruned", "pruned")) for k in range(3))
    return "WITH RECURSIVE " + ",".join(body) + f"""
SELECT *, (edits_0 + edits_1 + edits_2)::BIGINT AS routing_edit_calls, leaf AS leaf_members, leaf AS exact_verifications, (edits_0 + edits_1 + edits_2 + leaf)::BIGINT AS total_edit_calls
FROM (SELECT {each}), (SELECT count(*) AS leaf FROM q3 JOIN m3 ON m3.parent = q3.parent)"""


def _draw(ordinal: str, salt: int, below: str) -> str:
    return f"((((({ordinal}) * 1103515245 + {salt * 12345 + 67890}) % 2147483647) * 48271) % 2147483647) % ({below})"


def _generated() -> str:
    """Five edit steps, one CTE each."""
    steps = ["""s0 AS (SELECT i AS ordinal, i % a AS start, i % 6 AS edits, i % 10 = 9 AS random, d.seq, ''::VARCHAR AS log
  FROM (SELECT unnest(range(1000)) AS i), (SELECT count(*) AS a FROM dw WHERE sequence_id < 10000) JOIN dw d ON d.sequence_id = i % a)"""]
    for k in range(5):
        kind = k % 3
        at = _draw("ordinal", 2 * k + 1, "length(seq) + 1" if kind == 1 else "greatest(length(seq), 1)")
        base = _draw("ordinal", 2 * k + 2, "4") if kind == 1 else "(instr('ACGT', substr(seq, pos + 1, 1)) + " + _draw("ordinal", 2 * k + 2, "3") + ") % 4"
        new = "''" if kind == 2 else f"substr('ACGT', ({base}) + 1, 1)"
        rest = "pos + 1" if kind == 1 else "pos + 2"
        steps.append(f"""s{k + 1} AS (SELECT ordinal, start, edits, random,
  CASE WHEN edits > {k} THEN substr(seq, 1, pos) || {new} || substr(seq, {rest}) ELSE seq END AS seq,
  CASE WHEN edits > {k} THEN log || ',{'SID'[kind]}' || pos ELSE log END AS log FROM (SELECT *, {at} AS pos FROM s{k}))""")
    noise = f"(SELECT string_agg(substr('ACGT', ({_draw('ordinal * 1009 + j', 7, '4')}) + 1, 1), '' ORDER BY j) FROM (SELECT unnest(range(50)) AS j))"
    name = "'q' || ordinal || CASE WHEN random THEN '_random_nohit' ELSE '_source' || start || '_steps' || edits || '_' || CASE WHEN log = '' THEN 'none' ELSE substr(log, 2) END END"
    return f"WITH {_CONTIGS}, " + ", ".join(steps) + f" SELECT ordinal, {name} AS name, CASE WHEN random THEN {noise} ELSE seq END AS seq FROM s5"


def oracle_sql() -> dict[str, str]:
    part_hits = _near(T, True)
    part_columns = "SELECT ordinal, query, contig, start, distance, strand, sequence_id FROM h"
    nodes = " UNION ALL ".join(f"SELECT node_id, {k} AS layer, parent AS parent_id, child_ordinal, center_id AS center_sequence_id, center_s AS center_seq FROM n{k}" for k in range(3))
    beacons = " UNION ALL ".join(f"SELECT parent, beacon_index FROM b{k}" for k in range(3))
    tables = " UNION ALL ".join(f"SELECT parent AS parent_id, child_ordinal, beacon_index::INTEGER AS beacon_index, distance::INTEGER AS distance FROM t{k}" for k in range(3))
    placed = " UNION ALL ".join(f"SELECT parent AS parent_id, beacon_index, child_ordinal FROM b{k}" for k in range(3))
    metrics = [
        ("format_version", "2"), ("window", "0"), ("stride", "1"), ("T", str(T)), ("windows", "(SELECT count(*) FROM w)"),
        *[(f"radius_{k}", str(_R[k])) for k in range(3)], *[(f"worlds_{k}", f"(SELECT count(*) FROM n{k})") for k in range(3)],
        ("leaf_memberships", "(SELECT count(*) FROM m3)"), ("beacons", f"(SELECT count(*) FROM ({beacons}))"), ("beacon_distances", f"(SELECT count(*) FROM ({tables}))"),
    ]
    pairs = f"FROM (SELECT p_partkey, {_CLEAN.format('p_name')} AS a FROM part), (SELECT n_nationkey, {_CLEAN.format('n_name')} AS b FROM nation)"
    edges = [50 * k // 6 for k in range(7)]
    cut = " UNION ALL ".join(f"SELECT {k} AS k, {a} AS a, {b - a} AS n" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    item = f"(SELECT item_id, {_FOLD} AS b FROM benchmark)"
    reads_ = f"""rs AS (SELECT ordinal, name, substr(r, 1, pos) || substr(r, pos + 2) AS seq FROM (
  SELECT item_id * 1000 + i AS ordinal, 'b' || item_id || '_' || i AS name, substr(b, (i * 50 + 1)::BIGINT, 50) AS r, (item_id % 50)::BIGINT AS pos
  FROM (SELECT item_id, b, unnest(range(length(b) // 50)) AS i FROM {item} WHERE length(b) >= 50)))"""
    found = {
        "clean_sequences": "SELECT doc_id, " + _CLEAN.format(r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')") + " AS bases FROM documents",
        "reverse_complement": f"WITH {_CONTIGS} SELECT contig_ordinal, {_RC.format('bases')} AS reversed FROM k",
        "contig_names": f"WITH {_CONTIGS} SELECT contig_ordinal, name FROM k",
        "window_ids": f"WITH {_CONTIGS} SELECT contig_ordinal, n AS window_count, first_id AS first_sequence_id FROM kw",
        "window_extract": f"WITH {_CONTIGS} SELECT sequence_id, contig, start, seq FROM dw",
        "window_limit": f"WITH {_CONTIGS} SELECT contig_ordinal, least(n, 1000 - first_id) AS window_count, first_id AS first_sequence_id FROM kw WHERE first_id < 1000",
        "location_lookup": f"WITH {_CONTIGS} SELECT i.sequence_id, d.contig, d.start FROM (SELECT first_id + n // 2 AS sequence_id FROM kw WHERE n > 0) i JOIN dw d ON d.sequence_id = i.sequence_id",
        "distance_exact": f"SELECT p_partkey, n_nationkey, levenshtein(a, b)::INTEGER AS distance {pairs}",
        "distance_bounded": f"SELECT p_partkey, n_nationkey, (CASE WHEN levenshtein(a, b) <= 11 THEN levenshtein(a, b) ELSE -1 END)::INTEGER AS distance {pairs}",
        "brute_force_hits": _near(2, False) + part_columns,
        "both_strand_hits": _near(3, True) + part_columns,
        "segment_hits": f"""WITH {_CONTIGS},
rb AS (SELECT item_id * 1000 + i AS ordinal, 'b' || item_id || '_' || i AS query, substr(b, (i * 50 + 1)::BIGINT, 50) AS r, (item_id % 50)::BIGINT AS pos
       FROM (SELECT item_id, b, unnest(range(length(b) // 50)) AS i FROM {item} WHERE length(b) >= 50)),
q AS (SELECT ordinal, query, substr(r, 1, pos) || substr(r, pos + 2) AS seq FROM rb),
g AS ({cut}),
l AS (SELECT DISTINCT d.seq, g.k, substr(d.seq, g.a + 1, g.n) AS x FROM dw d, g),
s AS (SELECT DISTINCT q.seq, g.k, substr(q.seq, (g.a + v.move + 1)::BIGINT, g.n) AS x FROM q, g, (SELECT unnest(range(-5, 6)) AS move) v
      WHERE g.a + v.move >= 0 AND g.a + v.move + g.n <= length(q.seq)),
c AS (SELECT DISTINCT s.seq AS seq, l.seq AS t FROM s JOIN l USING (k, x)),
f AS (SELECT seq, t, levenshtein(seq, t)::INTEGER AS distance FROM c)
SELECT q.ordinal, q.query, d.contig, d.start, f.distance, '+' AS strand, d.sequence_id FROM q JOIN f USING (seq) JOIN dw d ON d.seq = f.t WHERE f.distance <= 5""",
        "dense_hits": f"""WITH k AS (SELECT doc_id AS contig_ordinal, 'doc_' || doc_id AS name, {_FOLD} AS bases FROM documents),
kc AS (SELECT *, greatest(length(bases) - 49, 0)::BIGINT AS n FROM k),
kw AS (SELECT *, coalesce(sum(n) OVER (ORDER BY contig_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id FROM kc),
rb AS (SELECT item_id * 1000 + i AS ordinal, 'b' || item_id || '_' || i AS query, substr(b, (i * 50 + 1)::BIGINT, 50) AS r, (item_id % 50)::BIGINT AS pos
       FROM (SELECT item_id, b, unnest(range(length(b) // 50)) AS i FROM {item} WHERE length(b) >= 50)),
q AS (SELECT ordinal, query, substr(r, 1, pos) || substr(r, pos + 2) AS seq FROM rb),
g AS (SELECT * FROM (VALUES (0, 0, 16), (1, 16, 17), (2, 33, 17)) v(k, a, n)),
s AS MATERIALIZED (SELECT DISTINCT q.seq, g.k, g.a, substr(q.seq, (g.a + v.move + 1)::BIGINT, g.n) AS x FROM q, g, (SELECT unnest(range(-2, 3)) AS move) v
      WHERE g.a + v.move >= 0 AND g.a + v.move + g.n <= length(q.seq)),
p AS (SELECT name, first_id, bases, n, unnest(range(length(bases) - 15)) AS at FROM kw WHERE n > 0),
c AS (SELECT DISTINCT s.seq, p.name, p.first_id, p.at - s.a AS start, substr(p.bases, (p.at - s.a + 1)::BIGINT, 50) AS t
      FROM p JOIN s ON s.x = substr(p.bases, (p.at + 1)::BIGINT, 16) AND s.k = 0 WHERE p.at - s.a BETWEEN 0 AND p.n - 1
      UNION SELECT DISTINCT s.seq, p.name, p.first_id, p.at - s.a, substr(p.bases, (p.at - s.a + 1)::BIGINT, 50)
      FROM p JOIN s ON s.x = substr(p.bases, (p.at + 1)::BIGINT, 17) AND s.k > 0 WHERE p.at - s.a BETWEEN 0 AND p.n - 1)
SELECT q.ordinal, q.query, c.name AS contig, c.start, levenshtein(c.seq, c.t)::INTEGER AS distance, '+' AS strand, c.first_id + c.start AS sequence_id
FROM c JOIN q USING (seq) WHERE levenshtein(c.seq, c.t) <= 2""",
        "passage_build": "WITH RECURSIVE " + _PASSAGES + ",\nm0 AS MATERIALIZED (SELECT 0::BIGINT AS parent, id, s FROM pw)," + _greedy(0, "m0", corpus.PASSAGE_CONFIG.radii[0])
                         + "\nSELECT child_ordinal, center_id AS center_sequence_id, center_s AS center_seq FROM c0",
        "passage_hits": _passage_hits("SELECT ordinal, query, contig, start, distance, strand, sequence_id FROM h"),
        "passage_hits_scan": _passage_hits("SELECT ordinal, query, contig, start, distance, strand, sequence_id FROM h"),
        "passage_verify": _passage_hits("SELECT count(*) AS expected_hits, count(*) AS observed_hits, 0::BIGINT AS false_negatives, 0::BIGINT AS false_positives FROM h"),
        "default_hits": _default_hits("SELECT ordinal, query, contig, start, distance, strand, sequence_id FROM h"),
        "default_verify": _default_hits("SELECT count(*) AS expected_hits, count(*) AS observed_hits, 0::BIGINT AS false_negatives, 0::BIGINT AS false_positives FROM h"),
        "fasta_contigs": f"WITH {_CONTIGS} SELECT row_number() OVER (ORDER BY contig_ordinal) - 1 AS contig_ordinal, name, bases FROM k",
        "fasta_reads": f"WITH {reads_} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, name || ' tail' AS name, seq FROM rs",
        "fastq_reads": f"WITH {reads_} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, name, seq FROM rs",
        "read_limit": f"WITH {reads_} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, name, seq FROM rs QUALIFY row_number() OVER (ORDER BY ordinal) <= 20",
        "in_memory_windows": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS sequence_id, 'sequence_' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS contig, 0::BIGINT AS start, upper(rpad(n_name, 12, 'n')) AS seq FROM nation",
        "tsv_round_trip": part_hits + "SELECT query, contig, start, distance, strand, sequence_id FROM h",
        "index_round_trip": _tree(3, "SELECT parent AS leaf_id, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS member_ordinal, id AS sequence_id FROM m3"),
        "index_file_round_trip": _tree(3, "SELECT parent AS leaf_id, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS member_ordinal, id AS sequence_id, s AS seq, 'part_' || id AS contig FROM m3"),
        "index_file_beacons": _tree(3, f"SELECT t.parent_id, t.child_ordinal, t.beacon_index, t.distance, b.child_ordinal AS beacon_ordinal FROM ({tables}) t JOIN ({placed}) b USING (parent_id, beacon_index)"),
        "index_file_hits": part_hits + part_columns,
        "index_bytes": _tree(3, f"SELECT (65 * (1 + (SELECT count(*) FROM ({nodes}))) + (SELECT sum(strlen(center_seq)) FROM ({nodes})) + (SELECT 8 * count(*) + sum(strlen(s)) FROM m3) "
                                f"+ 8 * (SELECT count(*) FROM ({beacons})) + 4 * (SELECT count(*) FROM ({tables})))::BIGINT AS index_bytes"),
        "descendants": _tree(3, "SELECT DISTINCT n1.parent AS node_id, m3.id AS sequence_id FROM m3 JOIN n2 ON n2.node_id = m3.parent JOIN n1 ON n1.node_id = n2.parent"),
        "query_stats_multilateration": _route_stats(),
        "hits_tsv_projection": part_hits + "SELECT concat_ws(chr(9), query, contig, start::VARCHAR, distance::VARCHAR, strand, sequence_id::VARCHAR) AS line FROM h",
        "greedy_centers": _tree(1, "SELECT child_ordinal, center_id, center_s FROM c0"),
        "center_edit_calls": _tree(1, "SELECT 0::BIGINT AS parent, center_edit_calls AS calls FROM (" + _stats_level(0) + ")"),
        "beacon_ordinals": _tree(1, "SELECT beacon_index::INTEGER AS beacon_index, child_ordinal FROM b0"),
        "beacon_table": _tree(3, tables),
        "lower_bounds": _tree(1, "SELECT r.ordinal, t.child_ordinal, max(abs(levenshtein(r.seq, c.center_s) - t.distance))::INTEGER AS lower_bound FROM rd r, t0 t JOIN b0 b ON b.beacon_index = t.beacon_index JOIN c0 c ON c.child_ordinal = b.child_ordinal GROUP BY ALL"),
        "classify_members": _tree(1, "SELECT child_ordinal, id, d::INTEGER AS distance FROM m1"),
        "world_sizes": _tree(3, f"""SELECT x.node_id, x.layer, mc AS member_count, coalesce(cc, 0) AS child_count, coalesce(bc, 0) AS beacon_count FROM (
  SELECT 0::BIGINT AS node_id, 3 AS layer, (SELECT count(*) FROM w) AS mc UNION ALL
  SELECT node_id, 0, (SELECT count(*) FROM m1 WHERE m1.parent = node_id) FROM n0 UNION ALL
  SELECT node_id, 1, (SELECT count(*) FROM m2 WHERE m2.parent = node_id) FROM n1 UNION ALL
  SELECT node_id, 2, (SELECT count(*) FROM m3 WHERE m3.parent = node_id) FROM n2) x
  LEFT JOIN (SELECT parent_id, count(*) AS cc FROM ({nodes}) GROUP BY ALL) y ON y.parent_id = x.node_id
  LEFT JOIN (SELECT parent, count(*) AS bc FROM ({beacons}) GROUP BY ALL) z ON z.parent = x.node_id"""),
        "pruning_stats": _tree(3, " UNION ALL ".join(_stats_level(k) for k in range(3))),
        "route_nearest": _tree(1, "SELECT ordinal, reverse, arg_min(node_id, d * 1000000 + node_id) AS node_id FROM (SELECT q.ordinal, q.reverse, n.node_id, levenshtein(q.seq, n.center_s) AS d FROM "
                               f"(SELECT ordinal, seq, false AS reverse FROM rd UNION ALL SELECT ordinal, {_RC.format('seq')}, true FROM rd) q, n0 n) GROUP BY ALL"),
        "hierarchy_nodes": _tree(3, "SELECT 0::BIGINT AS node_id, 3 AS layer, NULL::BIGINT AS parent_id, NULL::BIGINT AS child_ordinal, NULL::BIGINT AS center_sequence_id, NULL::VARCHAR AS center_seq UNION ALL " + nodes),
        "leaf_members": _tree(3, "SELECT parent AS leaf_id, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS member_ordinal, id AS sequence_id FROM m3"),
        "index_summary": _tree(3, " UNION ALL ".join(f"SELECT '{m}' AS metric, ({v})::BIGINT AS value" for m, v in metrics)),
        "index_hits": part_hits + part_columns,
        "verify_counts": part_hits + "SELECT count(*) AS expected_hits, count(*) AS observed_hits, 0::BIGINT AS false_negatives, 0::BIGINT AS false_positives FROM h",
        "hit_order_rank": part_hits + "SELECT ordinal, sequence_id, strand, (row_number() OVER (PARTITION BY ordinal ORDER BY sequence_id, CASE strand WHEN '+' THEN 0 ELSE 1 END, distance))::INTEGER AS place FROM h",
        "query_stats_scan": _tree(3, """SELECT (e0 + e1 + e2)::BIGINT AS routing_edit_calls, leaf::BIGINT AS leaf_members, leaf::BIGINT AS exact_verifications, (e0 + e1 + e2 + leaf)::BIGINT AS total_edit_calls FROM (
  SELECT sum((SELECT count(*) FROM n0)) AS e0, sum((SELECT count(*) FROM n1 WHERE n1.parent = a)) AS e1, sum((SELECT count(*) FROM n2 WHERE n2.parent = b)) AS e2, sum((SELECT count(*) FROM m3 WHERE m3.parent = c)) AS leaf FROM (
  SELECT a, b, (SELECT arg_min(node_id, levenshtein(seq, center_s) * 1000000 + node_id) FROM n2 WHERE n2.parent = b) AS c FROM (
  SELECT seq, a, (SELECT arg_min(node_id, levenshtein(seq, center_s) * 1000000 + node_id) FROM n1 WHERE n1.parent = a) AS b FROM (
  SELECT seq, (SELECT arg_min(node_id, levenshtein(seq, center_s) * 1000000 + node_id) FROM n0) AS a FROM rd))))"""),
        "generated_reads": _generated(),
        "latency_percentiles": """SELECT count(value) AS queries, avg(value) / 1000 AS mean_latency_us, v[floor(0.5::DOUBLE * (len(v) - 1))::BIGINT + 1] / 1000 AS p50_us,
 v[floor(0.95::DOUBLE * (len(v) - 1))::BIGINT + 1] / 1000 AS p95_us, v[floor(0.99::DOUBLE * (len(v) - 1))::BIGINT + 1] / 1000 AS p99_us
FROM events, (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL) GROUP BY v""",
    }
    return found | {"seed_table_hits": found["dense_hits"]}
