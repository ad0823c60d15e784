"""URL filter: rules first, link-graph propagation for what no rule decides.

Rules name a host (and its subdomains) and a path prefix; the longest fitting rule
decides a url.  Where none fits, the host decides: personalised PageRank spreads trust
from trusted hosts along host edges, and distrust from blocked hosts against them
(who links to a blocked host is suspect), until a round moves less than ``TOLERANCE``.  Each round
shrinks what moves by the damping factor, so some ninety rounds are the most.  A host whose distrust exceeds its trust by the
threshold is blocked, any other is allowed.

Seeds follow from the rules: a host is trusted if rules allow more than half of its
urls, blocked if they block more than half.  Host edges are the links of the
pages that name a host (``http://``, ``https://`` or ``//``) and the step from a host to the hosts above it, as far as these have pages.

Everything is joins and grouped sums; edges are counted with partial aggregation before
any shuffle, so one hub host is one row per linking host.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and no
edges, and is allowed; a null or empty html has no links; repeated rows are judged alike, each on
its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, written

DAMPING, MARGIN = 0.85, 0.0
#: Propagation ends when a round moves less than this share of both vectors' mass.
TOLERANCE, CHECK_EVERY = 1e-6, 4
#: Rules beyond this number are joined by shuffle; up to it they are broadcast.
BROADCAST_RULES = 100_000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def _hosts_above(host: Column, itself: bool) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1 if itself else 2), F.greatest(F.size(labels), F.lit(1 if itself else 2))),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, "host/path")`` pairs -> rows ``(rule_host, rule_path, rule, rule_verdict)``."""
    rows = [(r.partition("/")[0].lower(), r[len(r.partition("/")[0]):], r, v) for v, r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")


def ruled(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest fitting rule (null where none fits).

    Rules are matched once per distinct host; the urls of a host then meet its rules.
    """
    hosts = urls.select("host").distinct().withColumn("rule_host", F.explode(_hosts_above(F.col("host"), True)))
    near = F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules
    fitting = (hosts.join(near, "rule_host")
               .groupBy("host").agg(F.collect_list(F.struct(
                   (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
                   "rule_path", "rule", "rule_verdict")).alias("fitting")))
    best = F.array_max(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return (urls.join(fitting, "host", "left").withColumn("best", best)
            .withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.rule_verdict"))
            .drop("fitting", "best"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``(src, dst, n)`` from absolute links, and from each host to those above it."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")),
                                 F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), 1)
    linked = (pages.select(F.col("host").alias("src"), F.explode(links).alias("url"))
              .select("src", host_of(F.concat(F.lit("://"), F.regexp_replace("url", "^[^/]*//", ""))).alias("dst")))
    hosts = pages.select("host").filter("host <> ''").distinct()
    above = (hosts.select(F.col("host").alias("src"), F.explode(_hosts_above(F.col("host"), False)).alias("host"))
             .join(hosts, "host", "left_semi").select("src", F.col("host").alias("dst")))
    return (linked.unionByName(above).filter("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``seeds(host, trusted, blocked)`` -> ``(host, trust, distrust)`` over all hosts of
    seeds and edges.  The teleport vectors sum to one; mass of hosts without links ends there."""
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    start = seeds.select("host", (F.col("trusted") / F.lit(float(total["t"] or 1))).alias("t0"),
                         (F.col("blocked") / F.lit(float(total["b"] or 1))).alias("d0"))
    out_n = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("all"))
    in_n = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("all"))
    along = (edges.withColumnRenamed("src", "host").join(out_n, "host")
             .select("host", F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("wt"), F.lit(0.0).alias("wd")))
    against = (edges.withColumnRenamed("dst", "host").join(in_n, "host")
               .select("host", F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("all")).alias("wd")))
    steps = written(along.union(against), "trust-steps")
    rank = start.select("host", F.col("t0").alias("t"), F.col("d0").alias("d"))
    zero = F.lit(0.0)

    def moved_on(rank: DataFrame) -> DataFrame:
        moved = (steps.join(rank, "host").groupBy(F.col("to").alias("host"))
                 .agg(F.sum(F.col("t") * F.col("wt")).alias("mt"), F.sum(F.col("d") * F.col("wd")).alias("md")))
        return (start.join(moved, "host", "full_outer")
                .select("host", ((1 - damping) * F.coalesce("t0", zero) + damping * F.coalesce("mt", zero)).alias("t"),
                        ((1 - damping) * F.coalesce("d0", zero) + damping * F.coalesce("md", zero)).alias("d")))

    def change(a: DataFrame, b: DataFrame) -> float:
        """Summed difference of both vectors."""
        b = b.select("host", F.col("t").alias("t2"), F.col("d").alias("d2"))
        apart = F.abs(F.coalesce("t", zero) - F.coalesce("t2", zero)) + F.abs(F.coalesce("d", zero) - F.coalesce("d2", zero))
        return a.join(b, "host", "full_outer").agg(F.sum(apart)).first()[0] or 0.0

    while True:
        before = rank
        for _ in range(CHECK_EVERY):
            rank = moved_on(rank)
        rank = written(rank, "trust-rank")
        # these rounds together halve the distance to the fixed point, so it is about this change by now
        if change(before, rank) < tolerance:
            break
    return rank.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", margin: float = MARGIN) -> DataFrame:
    """Rows ``(id, host, path, rule, verdict, trust, distrust)``, one per input row."""
    spark = pages.sparkSession
    table = rules_table(spark, rules)
    rows = only(pages, id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).drop("url")
    judged = written(ruled(rows.drop("html"), table, len(rules)), "urls-ruled")
    edges = written(host_edges(rows), "host-edges")
    allowed, blocked = (F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0)) for v in ("allow", "block"))
    seeds = (judged.filter("host <> ''").groupBy("host").agg(allowed.alias("a"), blocked.alias("b"))
             .select("host", (F.col("a") > 0.5).cast("int").alias("trusted"), (F.col("b") > 0.5).cast("int").alias("blocked")))
    ranks = propagate(seeds, edges)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > trust + margin, F.lit("block")).otherwise(F.lit("allow"))
    return (judged.join(ranks, "host", "left")
            .select(F.col("id").alias(id_col), "host", "path", "rule",
                    F.coalesce("rule_verdict", by_host).alias("verdict"),
                    trust.alias("trust"), distrust.alias("distrust")))
