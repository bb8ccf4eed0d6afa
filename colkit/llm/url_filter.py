"""URL filtering by a path-template tree, with DataFrame functions only.

Rules come first: a rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's
path; the longest wins.  The verdicts of the rules are the labels from which the rest is judged:

* per host, paths are split in segments; segments that look like numbers or identifiers are
  variable and become ``*``;
* level by level, literal siblings under one template are compared with their pooled siblings by a
  two-proportion test; those that do not differ, or are too rare to tell, are merged into ``*``; this
  ends where no branch has children that could be kept;
* a template's purity is its share of blocked labels, smoothed with its host's, which is
  smoothed with that of all hosts; templates at or over ``reject`` are blocked.

At scale: pages are pre-aggregated to distinct (host, generalised segments) before the tree
is built.  Siblings are pooled by aggregates, which combine before the shuffle, and joined from written tables, so the skew
join splits a host, branch or template with very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary from page to page: digits with an optional extension, hexadecimal identifiers.
VARIABLE = r"^([0-9]+(\.[A-Za-z0-9]+)?|[0-9a-fA-F-]{16,})\z"
#: Levels that the SQL in oracles.py writes out; the tree here goes to the end of each path, so deeper paths may differ from it.
LEVELS = 4
MIN_SUPPORT, Z_LIMIT, SMOOTHING, REJECT = 5, 2.58, 2.0, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    none = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), none), F.coalesce(path, none)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules`` are (verdict, "host/path") pairs.

    The list of rules is a parameter, checked one by one in the expression; long lists would be a join on
    host suffixes.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, slash, tail = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All segments of a path, variable ones as ``*``."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def _share(block: Column, n: Column) -> Column:
    return block / F.nullif(n.cast("double"), F.lit(0.0))


def build_templates(shapes: DataFrame, *, min_support: int = MIN_SUPPORT, z_limit: float = Z_LIMIT) -> DataFrame:
    """(host, segs, n, labelled, blocked) -> the same and template.

    A literal child needs ``min_support`` pages, so a branch with fewer gets ``*`` for all that is left of its paths at once.
    """
    tree, level = shapes.select("*", F.lit("").alias("template"), (F.size("segs") > 0).alias("open")), 0
    done, tree = tree.where("not open"), tree.where("open")
    while not tree.isEmpty():
        here = F.get("segs", F.lit(level))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        kids = written(tree.where(here.isNotNull()).groupBy("host", "template", here.alias("seg")).agg(*sums), "url-kids")
        # siblings are pooled by an aggregate and a join: a branch with very many children is not one task
        pool = kids.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        kids = kids.join(written(pool, "url-pools", narrow=True), ["host", "template"])
        rest = (F.col("all_labelled") - F.col("labelled")).alias("rest_n"), (F.col("all_blocked") - F.col("blocked")).alias("rest_b")
        kids = kids.select("host", "template", "seg", "n", "labelled", "blocked", *rest, (F.col("all_n") < min_support).alias("few"))
        p = (F.col("blocked") + F.col("rest_b")) / F.nullif((F.col("labelled") + F.col("rest_n")).cast("double"), F.lit(0.0))
        spread = p * (1.0 - p) * (1.0 / F.nullif(F.col("labelled").cast("double"), F.lit(0.0)) + 1.0 / F.nullif(F.col("rest_n").cast("double"), F.lit(0.0)))
        gap = _share(F.col("blocked"), F.col("labelled")) - _share(F.col("rest_b"), F.col("rest_n"))
        differs = F.coalesce((spread > 0) & (gap * gap > F.lit(z_limit * z_limit) * spread), F.lit(False))
        own = (F.col("seg") != "*") & ((differs & (F.col("labelled") >= min_support)) | ((F.col("labelled") == 0) & (F.col("n") >= min_support)))
        known = written(kids.select("host", "template", "seg", "few", own.alias("own")).where("few or own"), "url-literals", narrow=True)
        tree = tree.withColumn("seg", here).join(known, ["host", "template", "seg"], "left")
        left, few = F.size("segs") - level, F.coalesce("few", F.lit(False))
        step = F.when(few, F.repeat(F.lit("/*"), left)).otherwise(F.concat(F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(F.lit("*"))))
        tree = written(tree.select("host", "segs", "n", "labelled", "blocked", F.concat("template", step).alias("template"), (~few & (left > 1)).alias("open")), "url-tree")
        done, tree, level = done.union(tree.where("not open")), tree.where("open"), level + 1
    return done.drop("open")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: int = MIN_SUPPORT,
    z_limit: float = Z_LIMIT,
    smoothing: float = SMOOTHING,
    reject: float = REJECT,
) -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict, template, purity).

    Null URLs and those without ``://`` have an empty host and path and are judged as pages of the
    empty host.  Repeated rows get equal verdicts.  Without any label the purity is 0 and all
    that no rule fits is allowed.  An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = columns(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("segs"))
    is_blocked = (F.col("ruled") == "block").cast("long")
    shapes = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.coalesce(F.sum(is_blocked), F.lit(0)).alias("blocked"))
    with Scratch(pages.sparkSession) as scratch:
        tree = build_templates(written(shapes, "url-shapes"), min_support=min_support, z_limit=z_limit)

        sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
        overall = tree.agg(*sums).first()
        base = (overall["blocked"] / overall["labelled"]) if overall["labelled"] else 0.0
        hosts = tree.groupBy("host").agg(*sums).select("host", ((F.col("blocked") + F.lit(smoothing * base)) / (F.col("labelled") + F.lit(smoothing))).alias("host_purity"))
        found = tree.groupBy("host", "template").agg(*sums).join(hosts, "host")
        found = found.select("host", "template", ((F.col("blocked") + F.lit(smoothing) * F.col("host_purity")) / (F.col("labelled") + F.lit(smoothing))).alias("purity"))
        found = written(tree.join(found, ["host", "template"]).select("host", "segs", "template", "purity"), "url-templates")
        judged = F.coalesce("ruled", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
        result = rows.join(found, ["host", "segs"], "left").select("page_id", "host", "path", "rule", judged.alias("verdict"), "template", "purity")
        return scratch.keep(result, found)
