"""URL filters by the ratio of two character language models.

Rules (a host with its subdomains, a path prefix) decide the urls they fit, the
longest rule first.  Urls that an allow rule fits are accepted examples, those
that a block rule fits rejected ones.  Two Markov models of variable order,
from 0 to ``order`` characters of context, are counted on four fifths of the
examples and smoothed by Witten-Bell interpolation with the next shorter
context.  A url's score is the mean over its characters of the difference of
the log-likelihoods; the last fifth of the examples calibrates it: scores of
both kinds are taken as normal with one variance, and a url that no rule fits
is allowed if its log odds are not negative.  Both kinds have equal priors, as
the rules' examples tell nothing about how frequent either is elsewhere.

All counting runs on distinct character windows, so the models and their joins
have as many rows as there are such windows, not as there are characters.
Everything is DataFrame functions; the driver sees six sums.

A null url has empty host and path and the score 0.  If one kind of example is
missing, every url that no rule fits is allowed.  Repeated rows come back as
often; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ORDER = 3
#: Characters that stand before a url's first and after its last one.
START, END = "\x02", "\x03"
FOLDS = 5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def windows(url: Column, order: int) -> Column:
    """For each character and the end, the string of up to ``order`` characters before it and itself, padded in front."""
    padded = F.concat(F.lit(START * order), url, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def log_ratios(stage: Stage, grams: DataFrame, order: int) -> DataFrame:
    """(gram, ratio) from (gram, yes, no): counts of full windows in accepted and rejected urls."""
    smooth = lambda n, low, total, kinds: F.when(total + kinds > 0, (n + kinds * low) / (total + kinds)).otherwise(low)
    table = None
    for k in range(order + 1):
        level = grams.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        of = level.groupBy(F.substring("g", 1, k).alias("h")).agg(
            F.sum("yes").alias("ny"), F.sum("no").alias("nn"), F.count(F.when(F.col("yes") > 0, 1)).alias("ty"), F.count(F.when(F.col("no") > 0, 1)).alias("tn"), F.count("*").alias("all")
        )
        level = level.withColumn("h", F.substring("g", 1, k)).join(of, "h")
        if table is None:
            flat = 1 / (F.col("all") + 1)
            level = level.withColumn("py", flat).withColumn("pn", flat)
        else:
            level = level.withColumn("shorter", F.substring("g", 2, k)).join(table, "shorter")
        table = level.select(F.col("g").alias("shorter"), smooth(F.col("yes"), F.col("py"), F.col("ny"), F.col("ty")).alias("py"), smooth(F.col("no"), F.col("pn"), F.col("nn"), F.col("tn")).alias("pn"))
    return stage.keep(table.select(F.col("shorter").alias("gram"), (F.log("py") - F.log("pn")).alias("ratio")))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """Rows (id, host, path, rule, verdict, score), one for each row of ``pages``."""
    stage = Stage(pages.sparkSession, "url-markov")
    url = F.col(url_col).cast("string")
    host, path = split_url(url)
    df = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    df = df.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("found.verdict").alias("own"), F.col("found.rule").alias("rule"))
    df = df.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)))
    taught = (F.col("own").isNotNull()) & (F.col("fold") > 0)
    grams = (
        df.where("url is not null").select("own", taught.alias("taught"), F.explode(windows(F.col("url"), order)).alias("gram"))
        .groupBy("gram").agg(F.count(F.when(F.col("taught") & (F.col("own") == "allow"), 1)).alias("yes"), F.count(F.when(F.col("taught") & (F.col("own") == "block"), 1)).alias("no"))
    )
    ratios = log_ratios(stage, stage.keep(grams), order)
    # one row for each url text, so that copies are scored once
    each = df.where("url is not null").select("url").distinct().select("url", F.explode(windows(F.col("url"), order)).alias("gram"))
    score = each.join(ratios, "gram").groupBy("url").agg(F.avg("ratio").alias("score"))
    scored = stage.keep(df.join(score, "url", "left").fillna(0.0, ["score"]))
    n = {}
    for r in scored.where("own is not null and fold = 0 and url is not null").groupBy("own").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_pop("score").alias("var")).collect():
        n[r["own"]] = (r["n"], r["mean"], r["var"])
    if len(n) == 2:
        (ny, my, vy), (nn, mn, vn) = n["allow"], n["block"]
        var = max(1e-9, (ny * vy + nn * vn) / (ny + nn))
        odds = (my - mn) / var * (F.col("score") - (my + mn) / 2)
        verdict = F.when(odds >= 0, "allow").otherwise("block")
    else:
        verdict = F.lit("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", verdict).alias("verdict"), "score")
