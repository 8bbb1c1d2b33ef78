"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path; the longest rule that fits decides. The
urls that rules decide are the labelled ones: trees are trained on them and judge the
urls that no rule fits. Features are lengths, depths, shares of digits, entropy,
parameter counts, and suffix statistics: how the labelled urls with the same last
host label, and the same file ending, were judged. Everything is DataFrame functions
and Spark's own boosted trees; there is no Python code on the executors.

The trees are fitted on a bounded sample of labelled urls (``train_rows``), in which each
label has a share of its own, so that a rare one is never left out; weights give the labels
the frequency they have. The suffix statistics count all of them, and every url is judged.

Defined cases: a null url, or one without "://", has an empty host and path and fits no
rule; without labelled urls of both kinds the method gives the one label there is, else
``default``; repeated rows are judged alike; extra columns ride along; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.common import table
from poolwright.session import materialize

TRAIN_ROWS = 20_000
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: verdict, host, start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

FEATURES = [
    "_length", "_host_length", "_path_length", "_host_labels", "_depth", "_digits", "_host_digits", "_hyphens",
    "_entropy", "_params", "_query_length", "_fragment", "_secure", "_host_share", "_ending_share",
]


def host_and_path(url: str) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decided(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical(pages: DataFrame, url: str) -> DataFrame:
    """Add the features that a url has on its own."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    # how often each character occurs: what is missing once it is taken out
    often = F.transform(F.array_distinct(F.split(u, "")), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / F.greatest(n, F.lit(1)))
    entropy = F.aggregate(often, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return pages.withColumns(
        {
            "_length": n.cast("double"),
            "_host_length": F.length("host").cast("double"),
            "_path_length": F.length("path").cast("double"),
            "_host_labels": _count(F.col("host"), r"[^.]+"),
            "_depth": _count(F.col("path"), r"[^/]+"),
            "_digits": _share(_count(u, r"[0-9]"), n),
            "_host_digits": _share(_count(F.col("host"), r"[0-9]"), F.length("host")),
            "_hyphens": _count(F.col("host"), "-"),
            "_entropy": entropy,
            "_params": _count(query, r"[^&]+"),
            "_query_length": F.length(query).cast("double"),
            "_fragment": F.length(F.regexp_extract(u, r"#(.*)", 1)).cast("double"),
            "_secure": u.startswith("https://").cast("double"),
            "_suffix": F.substring_index("host", ".", -1),
            "_ending": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1),
        }
    )


def _statistics(labelled: DataFrame, column: str, name: str) -> DataFrame:
    """Smoothed share of allowed urls for each value of ``column``; stored, so that its size is known."""
    share = (F.sum("_label") + 1) / (F.count(F.lit(1)) + 2)
    return materialize(labelled.groupBy(F.col(column).alias(f"{name}_of")).agg(share.alias(name)))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url",
    train_rows: int = TRAIN_ROWS, default: str = DEFAULT, trees: int = 15, depth: int = 4, train_on: str = "true",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and method (what the trees say, of every url) added.

    ``train_on`` is a condition on the columns of ``pages``: labelled urls that do not meet it are kept
    out of training.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    host, path = host_and_path(url)
    columns = [F.col(f"`{c}`") for c in pages.columns]
    found = pages.select(
        F.struct(*columns).alias("_row"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"), F.expr(train_on).alias("_train")
    )
    rule, verdict = decided(rules)
    found = lexical(found.withColumn("rule", rule).withColumn("_verdict", verdict), "_url")
    found = found.withColumn("_label", (F.col("_verdict") == "allow").cast("double"))
    found = found.withColumn("_draw", F.xxhash64("_url", F.lit(7)))
    labelled = found.filter("_verdict is not null and _train")
    least = [F.min(F.when(F.col("_label") == v, F.col("_draw"))).alias(f"least{v}") for v in (0, 1)]
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("allowed"), *least).first()
    out = [*[F.col("_row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "method")], "host", "path", "rule"]
    if not total["n"] or total["allowed"] in (0, total["n"]):
        only = default if not total["n"] else "allow" if total["allowed"] else "block"
        return found.select(*out, F.coalesce("_verdict", F.lit(only)).alias("verdict"), F.lit(only).alias("method"))

    for column, name in (("_suffix", "_host_share"), ("_ending", "_ending_share")):
        found = found.join(_statistics(labelled, column, name), F.col(column) == F.col(f"{name}_of"), "left")
        found = found.withColumn(name, F.coalesce(name, F.lit(0.5)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    rows = {1: int(total["allowed"]), 0: total["n"] - int(total["allowed"])}
    drawn = F.lit(False)
    for v, n in rows.items():  # the url drawn first is always taken: no label is missing
        share = min(1.0, max(train_rows // 2, train_rows - rows[1 - v]) / n)
        some = (F.pmod("_draw", F.lit(1 << 20)) < int(share * (1 << 20))) | (F.col("_draw") == total[f"least{v}"])
        drawn = drawn | ((F.col("_label") == v) & some)
    few = found.filter("_verdict is not null and _train").filter(drawn)
    train = materialize(few.groupBy("_label", *FEATURES).agg(F.count(F.lit(1)).alias("_times")))  # a repeated url is one row
    taken = {int(r["_label"]): r["n"] for r in train.groupBy("_label").agg(F.sum("_times").alias("n")).collect()}
    weight = F.col("_times") * F.when(F.col("_label") == 1, rows[1] / taken[1]).otherwise(rows[0] / taken[0])
    train = train.withColumn("_weight", weight)
    boosted = GBTClassifier(labelCol="_label", featuresCol="_features", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=1, cacheNodeIds=False)
    model = boosted.fit(vectors.transform(train))
    judged = model.transform(vectors.transform(found))
    method = F.when(F.col("prediction") == 1, "allow").otherwise("block")
    return judged.select(*out, F.coalesce("_verdict", method).alias("verdict"), method.alias("method"))


def op7(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
