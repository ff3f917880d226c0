"""URL filter: explicit rules first, else a per-host tree of path templates.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end.  A null url or one without ``://`` has
an empty host and path.  A rule fits its host and all its subdomains if the path starts
with the rule's path; the longest rule wins, among equals the first by code point.

Method for urls that no rule fits.  Pages that a rule fits are the labelled ones.
1. Segments with a digit become ``*`` at once, so that counts per (host, template, shape) are a
   small table; all later steps work on it.  A page's shape is its path with runs of digits as
   9 and runs of other characters, but for ``/ . - _``, as a.
2. Children of one tree node become ``*`` when the node has more than ``MAX_CHILDREN`` of them
   and the child holds less than one in ``MIN_SHARE`` of its rows: all nodes of any depth at once, and again
   until no node changes (a node whose parents have become one may be wide by then).
3. Branches of a host with wildcards at the same places and the same commonest shape are merged, with
   or without labels, where their pages look alike: a branch's counts of shapes are held against those
   of the others (chi-square test at 5 %), and those that don't differ are one branch.  So labels reach the unlabelled branches that
   are built as the labelled ones are.
4. A branch is blocked if its smoothed purity (blocked + ALPHA * PRIOR) /
   (labelled + ALPHA) is at least ``REJECT``; without labels it is allowed.

Rows that repeat a page each get a verdict; null page ids too.  An empty table gives no rows.  Columns
other than page_id and url are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampspark.llm.common import Scratch, hot_keys, spread_join

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MAX_CHILDREN = 20
MIN_SHARE = 20
ALPHA = 4.0
PRIOR = 0.25
REJECT = 0.5
Z = 1.6449  # one-sided 5 % point of the normal distribution
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest fitting rule, else null.  ``rules`` is a short list, compiled into the plan."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def template_of(path: Column) -> Column:
    """The path's segments in a row, those with a digit as ``*``; empty segments don't count."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x)), "/")


def shape_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[0-9]+", "9"), r"[^9/.\-_]+", "a")


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumns({"fit": rule_of(F.col("host"), F.col("path"), rules), "template": template_of(F.col("path")), "uid": F.monotonically_increasing_id()})


def _generalised(templates: DataFrame, scratch: Scratch) -> DataFrame:
    """host, template, t: the template after rare children of wide nodes became wildcards.  ``templates`` has host, template (unique) and n."""
    now = scratch.put(templates.select("host", "template", F.col("template").alias("t"), "n"), "templates")
    while True:
        s = F.split("t", "/")
        each = now.select("host", "template", "n", F.posexplode(s).alias("i", "child"), s.alias("s"))
        each = each.select("host", "template", "n", "i", "child", F.xxhash64(F.slice("s", F.lit(1), F.col("i"))).alias("node"))
        node = ["host", "i", "node"]
        child = scratch.put(each.groupBy(*node, "child").agg(F.sum("n").alias("rows")), "children")
        wide = child.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("rows").alias("all_rows"), F.count_if(F.col("child") != "*").alias("named")).where(
            (F.col("children") > MAX_CHILDREN) & (F.col("named") > 0)
        )
        rare = child.join(wide.select(*node, "all_rows"), node).where((F.col("rows") * MIN_SHARE < F.col("all_rows")) & ~F.col("child").isin("*", ""))
        rare = scratch.put(rare.select(*node, "child"), "rare")
        if not rare.limit(1).count():
            return now.select("host", "template", "t")
        hit = each.join(rare, [*node, "child"]).groupBy("host", "template").agg(F.collect_set("i").alias("at"))
        new = F.array_join(F.transform(s, lambda x, i: F.when(F.array_contains("at", i), "*").otherwise(x)), "/")
        now = scratch.put(now.join(hit, ["host", "template"], "left").select("host", "template", F.when(F.col("at").isNull(), F.col("t")).otherwise(new).alias("t"), "n"), "templates")


def _critical(df: Column) -> Column:
    """5 % point of the chi-square distribution (Wilson and Hilferty's approximation)."""
    part = F.lit(2.0) / (9 * df)
    return df * F.pow(1 - part + Z * F.sqrt(part), F.lit(3))


def merged_branches(shapes: DataFrame) -> DataFrame:
    """host, t, alike (merged with the like branches of its pool), bad, seen: of the branch it was merged into.

    ``shapes`` has host, t, shape, n, bad, seen.  All tables have a row per (host, t, shape) at most.
    """
    wildcards = F.transform(F.split("t", "/"), lambda x: F.when(x == "*", "*").otherwise("a"))
    b = shapes.groupBy("host", "t", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "seen")])
    most = b.groupBy("host", "t").agg(F.max(F.struct("n", "shape"))["shape"].alias("most"))
    b = b.join(most, ["host", "t"]).withColumn("pool", F.concat(F.array_join(wildcards, "/"), F.lit(" "), "most")).drop("most")
    own = b.groupBy("host", "pool", "t").agg(F.sum("n").alias("branch_n"), F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    pool = own.groupBy("host", "pool").agg(F.sum("branch_n").alias("pool_n"), F.count(F.lit(1)).alias("branches"))
    every = b.groupBy("host", "pool", "shape").agg(F.sum("n").alias("shape_n"))
    kinds = every.groupBy("host", "pool").agg(F.count(F.lit(1)).alias("kinds"))
    # Shapes that a branch lacks count with its expected number of them: the sums over all shapes are those of the others' totals.
    x, share = F.col("n").cast("double"), F.col("shape_n") / F.col("pool_n").cast("double")
    e1, e2 = F.col("branch_n") * share, (F.col("pool_n") - F.col("branch_n")) * share
    have = b.select("host", "pool", "t", "shape", "n").join(own.select("host", "pool", "t", "branch_n"), ["host", "pool", "t"]).join(every, ["host", "pool", "shape"]).join(pool, ["host", "pool"])
    off = have.where("branches > 1").groupBy("host", "pool", "t").agg(F.sum((x - e1) * (x - e1) / e1 + (x - e1) * (x - e1) / e2).alias("off"), F.sum(e1 + e1 * e1 / e2).alias("held"), F.first("branch_n").alias("m"), F.first("pool_n").alias("all_n"))
    # A lacking shape adds e1 + e1**2 / e2; over all shapes that is m + m**2 / (all - m).
    m, rest = F.col("m").cast("double"), (F.col("all_n") - F.col("m")).cast("double")
    chi = off.join(kinds, ["host", "pool"]).select("host", "pool", "t", "kinds", (F.col("off") + (m + m * m / rest) - F.col("held")).alias("chi"))
    test = chi.select("host", "pool", "t", ((F.col("kinds") == 1) | (F.col("chi") <= _critical((F.greatest(F.col("kinds") - 1, F.lit(1))).cast("double")))).alias("alike"))
    b = own.join(test, ["host", "pool", "t"], "left").withColumn("alike", F.coalesce("alike", F.lit(False)))
    together = b.where("alike").groupBy("host", "pool").agg(F.sum("bad").alias("m_bad"), F.sum("seen").alias("m_seen"))
    b = b.join(together, ["host", "pool"], "left")
    return b.select("host", "t", "alike", F.when(F.col("alike"), F.col("m_bad")).otherwise(F.col("bad")).alias("bad"), F.when(F.col("alike"), F.col("m_seen")).otherwise(F.col("seen")).alias("seen"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per page."""
    scratch = Scratch(pages.sparkSession)
    rows = parsed(pages, rules)
    fit = F.col("fit.verdict")
    shapes = rows.groupBy("host", "template", shape_of(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((fit == "block").cast("long"), F.lit(0))).alias("bad"), F.count(fit).alias("seen")
    )
    shapes = scratch.put(shapes, "shapes")
    templates = scratch.put(shapes.groupBy("host", "template").agg(F.sum("n").alias("n")), "counts")
    general = scratch.put(_generalised(templates, scratch), "general")
    branches = merged_branches(shapes.join(general, ["host", "template"]))
    gone = branches.where((F.col("bad") + ALPHA * PRIOR) / (F.col("seen") + ALPHA) >= REJECT)
    rejected = general.join(gone.select("host", "t"), ["host", "t"]).join(templates, ["host", "template"]).select("host", "template", "n")
    rejected = scratch.put(rejected, "rejected")
    hot = hot_keys(rejected, ["host", "template"])
    free = spread_join(rows, rejected.select("host", "template", F.lit(True).alias("reject")), ["host", "template"], hot, F.col("uid"), "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("reject"), "block").otherwise("allow"))
    scratch.clear(rejected)
    return free.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
