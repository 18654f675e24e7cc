"""URL filter with DataFrame functions only: rules first, else a tree of path templates per host.

Level by level a host's paths are generalised: digits become wildcards, children whose share of good
labels does not differ from the node's are merged, and of a node that has very many children also
those that hold little of it and too few labels to tell.  A template is rejected if its smoothed
purity, the share of good labels, is low.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import stored

WILD = "*"
#: In a node with more children than this, those with less than one row in as many need ``PRIOR_LABELS`` to stay apart.
MOST_BRANCHES = 16
#: Standard errors by which a child's purity must differ from its node's to stay apart.
APART = 2.0
#: Labels' worth of the overall purity that every template starts with.
PRIOR_LABELS = 8.0
#: Templates of lower smoothed purity are rejected.
LEAST_PURITY = 0.5
#: Segments from this one on count as one.
LEVELS = 8
#: Rules written into the plan.
MOST_RULES = 500
#: Rejected paths broadcast at most; more are met by a shuffled join.
MOST_REJECTED = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# --- rules -------------------------------------------------------------------------------------
def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (``host/path`` as written) that fits, null if none does; ties by text.

    A rule fits its host and the host's subdomains if the path starts with the rule's path.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        its_host, slash, rest = rule.partition("/")
        fits = (host == its_host) | host.endswith(f".{its_host}")
        out = F.when(fits & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


def rule_verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


# --- templates ---------------------------------------------------------------------------------
def shape_of(path: Column) -> Column:
    """The path with every run of digits as a wildcard, repeated and closing slashes left out."""
    digits = F.regexp_replace(path, "[0-9]+", F.lit(WILD))
    return F.regexp_replace(F.regexp_replace(digits, "/+", "/"), r"(?s)(?<=.)/\z", "")


def _segments(shape: Column) -> Column:
    """Up to ``LEVELS`` segments, the last holding all that is left."""
    parts = F.array_remove(F.split(shape, "/"), "")
    tail = F.concat_ws("/", F.slice(parts, LEVELS, F.greatest(F.size(parts), F.lit(1))))
    return F.when(F.size(parts) <= LEVELS, parts).otherwise(
        F.concat(F.slice(parts, 1, LEVELS - 1), F.array(tail))
    )


def _pooled(label: str = "good") -> list[Column]:
    return [F.sum(c).alias(c) for c in ("rows", "labelled", label)]


def _one_level(tree: DataFrame, level: int) -> DataFrame:
    """The tree with the segment of one level added to each template, wild or as it is."""
    segment = F.get("segments", F.lit(level))
    here = tree.withColumn("segment", segment)
    node = ["host", "template"]
    child = here.where(F.col("segment").isNotNull()).groupBy(*node, "segment").agg(*_pooled())
    whole = child.groupBy(*node).agg(
        F.count(F.lit(1)).alias("branches"),
        F.sum("rows").alias("all_rows"),
        F.sum("labelled").alias("all_labelled"),
        F.sum("good").alias("all_good"),
    )
    judged = child.join(whole, node)
    small = (F.col("branches") > MOST_BRANCHES) & (F.col("rows") * MOST_BRANCHES < F.col("all_rows"))
    # with fewer labels than the prior's worth a template of its own says little; more are never pooled away
    unsure = small & (F.col("labelled") < PRIOR_LABELS)
    pooled = F.col("all_good") / F.greatest("all_labelled", F.lit(1))
    differs = F.abs(F.col("good") - F.col("labelled") * pooled)
    error = F.sqrt(F.col("labelled") * pooled * (1 - pooled))
    same = differs <= APART * error + F.lit(1e-9)
    key = F.when(unsure | same, F.lit(WILD)).otherwise(F.col("segment"))
    keys = judged.select(*node, "segment", key.alias("key"))
    joined = here.join(keys, [*node, "segment"], "left")
    longer = F.when(F.col("key").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "key"))
    return joined.withColumn("template", longer).drop("key", "segment")


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, shape, template, rows, labelled, good, purity) from rows of host, path and ``good``.

    ``good`` is true, false, or null without a label.  Rows are counted per (host, shape)
    before anything else, so that a host with most of the rows is a few counts.
    """
    good = F.col("good").cast("int")
    shapes = urls.groupBy("host", shape_of(F.col("path")).alias("shape")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(good).alias("labelled"), F.coalesce(F.sum(good), F.lit(0)).alias("good")
    )
    tree = shapes.withColumn("segments", _segments(F.col("shape"))).withColumn("template", F.lit(""))
    tree = stored(tree, "shapes")
    deepest = tree.agg(F.max(F.size("segments")).alias("n")).first().n or 0
    for level in range(deepest):
        tree = stored(_one_level(tree, level), "tree")
    total = tree.agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).first()
    prior = total.good / total.labelled if total.labelled else 1.0
    per = tree.groupBy("host", "template").agg(*_pooled())
    purity = (F.col("good") + PRIOR_LABELS * prior) / (F.col("labelled") + PRIOR_LABELS)
    per = per.withColumn("purity", purity)
    return tree.select("host", "shape", "template").join(per, ["host", "template"])


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str = "good",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template purity where it was rejected.

    ``labels`` has a url and a good flag; each labelled row counts.  The verdict is the
    rule's, else ``block`` where the template's purity is below ``LEAST_PURITY`` and
    ``allow`` elsewhere.  Null urls and urls without ``://`` have empty host and path and are one
    template of their own.  Without labels only rules block.
    """
    every = pages.select(F.col(url_col).alias("url")).withColumn("good", F.lit(None).cast("boolean"))
    known = labels.select(F.col(url_col).alias("url"), F.col(label_col).cast("boolean").alias("good"))
    known = known.where(F.col("good").isNotNull())
    # a labelled url of the pages counts once as a row and once as a label
    urls = every.unionByName(known).select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "good"
    )
    tree = template_tree(urls)
    rejected = stored(
        tree.where(F.col("purity") < LEAST_PURITY).select("host", "shape", "template", "purity"), "rejected"
    )
    if rejected.limit(MOST_REJECTED + 1).count() <= MOST_REJECTED:
        rejected = F.broadcast(rejected)
    rows = pages.select(
        F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    rows = rows.withColumn("shape", shape_of(F.col("path"))).join(rejected, ["host", "shape"], "left")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("purity").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), learned)
    return rows.select(
        id_col, "host", "path", "rule", verdict.alias("verdict"), F.col("template").alias("rejected_template"), "purity"
    )
