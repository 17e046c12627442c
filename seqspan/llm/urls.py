"""URL filter: listed rules first, else empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix.  Each level is a
beta-binomial whose prior is its parent's posterior mean, with a strength estimated by
moments over that level's groups.  A host is blocked if the lower ``sure`` bound of its beta
posterior exceeds ``block_above``, which is to say: if the posterior chance that its bad share
is above ``block_above`` is over ``sure``.  That chance is the regularised incomplete beta
function, evaluated by its continued fraction.  DataFrame functions only.

The registered domain is the label before the suffix.  A suffix is the last label, or two if
``SUFFIXES`` (a short list, to be replaced by a fuller one) names them; ports and user names
do not count, and a numeric address is a domain and suffix of its own.

Nulls: a null url or one without ``://`` has an empty host and path (a host of its own); a
page without an outcome counts for no host but is judged; an outcome with a null flag is
none.  Repeated pages count as often as they stand.  Empty tables give empty results; with
no outcomes at all nothing is blocked beyond the rules.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspan.llm.common import fresh, spare, stored, work_dir

SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co",
    "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "gov.au", "gov.br", "gov.uk", "ltd.uk",
    "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
    "plc.uk", "sch.uk",
)
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host (or a parent of it) and the start of the path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # later ones wrap earlier ones
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] | None = None) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*(SUFFIXES if suffixes is None else suffixes))
    address = bare.rlike(r"^(\[.*\]|[0-9.]+)$")
    suffix = F.when(address, bare).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    return F.when(address, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two), suffix


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the product of what lies between."""
    z, between = x + 8, x
    for k in range(1, 8):
        between = between * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - F.ln(between)


def beta_above(a: Column, b: Column, x: float, terms: int = 300) -> Column:
    """P(share > x) under beta(a, b), 0 < x < 1.  The fraction is taken on the side where it
    converges; ``terms`` are enough for counts of some ten thousand, and with more the share
    of labelled pages lies so near its mean that what is missing does not matter."""
    far = F.lit(x) > (a + 1) / (a + b + 2)  # then work on 1 - share
    p, q, y = F.when(far, b).otherwise(a), F.when(far, a).otherwise(b), F.when(far, F.lit(1 - x)).otherwise(F.lit(x))
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(acc: Column, m: Column) -> Column:
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return F.transform(F.array(acc), lambda s: _twice(s, even, odd, safe))[0]

    first = 1 / safe(1 - (p + q) * y / (p + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    h = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step)["h"]
    front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.ln(y) + q * F.ln(1 - y)) / p
    below = F.least(F.lit(1.0), F.greatest(F.lit(0.0), front * h))
    return F.when(far, below).otherwise(1 - below)


def _twice(s: Column, even: Column, odd: Column, safe) -> Column:
    """Two steps of Lentz's rule on (c, d, h), one value at a time through nested lambdas."""
    half = lambda t, k: F.struct(safe(1 + k / t["c"]).alias("c"), (1 / safe(1 + k * t["d"])).alias("d"), t["h"].alias("h"))
    done = lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (t["h"] * t["c"] * t["d"]).alias("h"))
    one = F.transform(F.array(half(s, even)), lambda t: half(done(t), odd))[0]
    return F.transform(F.array(one), done)[0]


def _strength(groups: DataFrame) -> Column:
    """Prior strength (1 - rho) / rho by moments over groups(n, k, p0); rho in [1e-4, 0.5]."""
    n, k, p = F.col("n"), F.col("k"), F.col("p0")
    many, total = F.sum(F.lit(1)), F.sum(n)
    spread = F.sum(n * (k / n - p) * (k / n - p))
    noise, p_all = F.max(p * (1 - p)), many - 1
    room = total - F.sum(n * n) / total - p_all
    rho = F.when((noise > 0) & (room > 0), (spread - noise * p_all) / (noise * room)).otherwise(F.lit(1e-4))
    rho = F.greatest(F.lit(1e-4), F.least(F.lit(0.5), F.coalesce(rho, F.lit(1e-4))))
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, *, block_above: float = 0.5, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``outcomes(host, bad)``, bad null where unlabelled -> host, n, k, bad_share (posterior
    mean) and bad_chance (posterior chance of a share above ``block_above``)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(0))).cast("long").alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    folder = work_dir(outcomes.sparkSession)
    hosts = stored(hosts.select("*", suffix.alias("suffix"), domain.alias("domain")), folder, "hosts")
    overall = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p0"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes_ = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # three strengths and the overall share are one row: each is a global aggregate
    one = overall
    for name, level in (("s_suffix", suffixes_), ("s_domain", domains), ("s_host", hosts)):
        one = one.join(level.where("n > 0").join(F.broadcast(overall)).agg(F.coalesce(_strength(level), F.lit(9999.0)).alias(name)))
    one = stored(one, folder, "priors")
    mean = lambda s, p: (F.col("k") + F.col(s) * F.col(p)) / (F.col("n") + F.col(s))
    by_suffix = suffixes_.join(F.broadcast(one)).select("suffix", mean("s_suffix", "p0").alias("p_suffix"), "s_domain", "s_host")
    by_domain = domains.join(by_suffix, "suffix").select("domain", mean("s_domain", "p_suffix").alias("p_domain"), "s_host")
    a = F.col("k") + F.col("s_host") * F.col("p_domain")
    b = F.col("n") - F.col("k") + F.col("s_host") * (1 - F.col("p_domain"))
    placed = hosts.join(by_domain, "domain").select("host", "n", "k", a.alias("a"), b.alias("b"))
    judged = placed.select("host", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_share"), beta_above(F.col("a"), F.col("b"), block_above).alias("bad_chance"))
    return stored(judged, folder, "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None,
          block_above: float = 0.5, sure: float = 0.95, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``outcomes(id_col, bad)`` holds 0/1 flags.  Adds host, path, rule, verdict, bad_share and
    bad_chance to ``pages`` (columns of these names are replaced)."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    pages = fresh(pages, ["host", "path", "rule", "verdict", "bad_share", "bad_chance"]).withColumns({"host": host, "path": path})
    flags = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("bad").alias("bad"))
    labelled = pages.select(F.col(id_col).alias("_id"), "host").join(flags, "_id", "left")
    other = spare(pages, "host")
    known = host_reputation(labelled.select("host", "bad"), block_above=block_above, suffixes=suffixes).select(F.col("host").alias(other), "bad_share", "bad_chance")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    listed = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))
    own = F.when(F.col("bad_chance") > sure, "block").otherwise("allow")
    joined = pages.join(known, F.col("host") == F.col(other), "left").drop(other)
    return joined.withColumn("rule", rule).withColumn("verdict", F.coalesce(listed, own))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when(F.coalesce(F.col("quality"), F.col("toxic")).isNotNull(), F.greatest(F.coalesce(1 - F.col("quality"), F.lit(0)), F.coalesce("toxic", F.lit(0))))
    out = judge(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
    return out.select("page_id", "host", "path", "rule", "verdict")


#: the posterior chance by the series of the tail's positive terms, not by the fraction
ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT doc_id, max(greatest(coalesce(1 - quality, 0), coalesce(toxic, 0))) AS bad FROM labels
      WHERE coalesce(quality, toxic) IS NOT NULL GROUP BY doc_id),
o1 AS (SELECT host, count(bad) AS n, sum(coalesce(bad, 0))::BIGINT AS k,
             regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare
      FROM h LEFT JOIN f ON page_id = doc_id GROUP BY host),
o2 AS (SELECT *, regexp_extract(bare, '([^.]*\.?[^.]*)$', 1) AS two, regexp_extract(bare, '([^.]*\.?[^.]*\.?[^.]*)$', 1) AS three,
              regexp_extract(bare, '([^.]*)$', 1) AS one, regexp_full_match(bare, '\[.*\]|[0-9.]+') AS address FROM o1),
o AS (SELECT host, n, k, CASE WHEN address THEN bare WHEN two IN ('{"', '".join(SUFFIXES)}') THEN two ELSE one END AS suffix,
             CASE WHEN address THEN bare WHEN two IN ('{"', '".join(SUFFIXES)}') THEN three ELSE two END AS domain FROM o2),
d AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM o GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY ALL),
g AS (SELECT (sum(k) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS p0 FROM o),
m AS (SELECT 'h' AS level, n, k FROM o WHERE n > 0 UNION ALL SELECT 'd', n, k FROM d WHERE n > 0 UNION ALL SELECT 's', n, k FROM s WHERE n > 0),
v AS (SELECT level, count(*) - 1 AS c, sum(n * (k / n - p0) * (k / n - p0)) AS spread, max(p0 * (1 - p0)) AS noise,
             sum(n)::DOUBLE - sum(n * n)::DOUBLE / sum(n)::DOUBLE - (count(*) - 1) AS room FROM m, g GROUP BY level),
r AS (SELECT level, greatest(1e-4::DOUBLE, least(0.5::DOUBLE, CASE WHEN noise > 0 AND room > 0 THEN (spread - noise * c) / (noise * room) ELSE 1e-4::DOUBLE END)) AS rho FROM v),
q AS (SELECT coalesce(max((1 - rho) / rho) FILTER (level = 's'), 9999) AS ss, coalesce(max((1 - rho) / rho) FILTER (level = 'd'), 9999) AS sd,
             coalesce(max((1 - rho) / rho) FILTER (level = 'h'), 9999) AS sh FROM r),
ps AS (SELECT suffix, (k + ss * p0) / (n + ss) AS p FROM s, q, g),
pd AS (SELECT d.domain, (k + sd * p) / (n + sd) AS p FROM d JOIN ps USING (suffix), q),
ab AS (SELECT host, k + sh * p AS a, n - k + sh * (1 - p) AS b FROM o JOIN pd USING (domain), q),
-- where a <= b the chance of a share above a half is a half at most; else 1 - chance = I(a, b) at 1/2, whose terms fall
tail AS (SELECT host, CASE WHEN a <= b THEN 1 ELSE exp(lgamma(a + b) - lgamma(a) - lgamma(b) - (a + b) * ln(2)) / a * (1 + list_sum(list_transform(range(1, 2000),
          lambda t: exp(lgamma(a + b + t) - lgamma(a + b) - lgamma(a + 1 + t) + lgamma(a + 1) - t * ln(2))))) END AS below FROM ab),
j AS (SELECT host, 1 - below AS chance FROM tail),
x AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN chance > 0.95 THEN 'block' ELSE 'allow' END AS verdict
FROM x JOIN j USING (host)
"""
