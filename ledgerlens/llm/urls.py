"""URL verdicts by host and path rules, then by the ratio of two character language models. DataFrame operations only.

Two Markov models of variable order are counted over all URLs: one of accepted and one of rejected URLs. The counts of
three-symbol strings are aggregated before the shuffle; the lower orders are sums of these. Witten-Bell smoothing mixes
each order with the one below by how many different symbols its context has been followed by. A URL is rejected if its
log-likelihood difference a symbol is under a cut calibrated on the accepted ones.

The symbols are the fixed ``ALPHABET`` and one for all others, so the model never has more than ``(len + 3) ** 3`` rows,
which is the bound of the one table that is broadcast.

This is distant supervision: nobody has labelled the URLs. Those that hold one of the words ``SEED_TERMS`` (a parameter) are
the rejected examples and all others the accepted ones, so the models can tell what looks like these words' URLs and
nothing else. Equal URLs are counted together before anything else. Null URLs, and those without
``://``, have an empty host and path, and no rule fits. A URL without symbols scores 0. Equal URLs get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint

#: Fixed rules: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Fixed words that mark the rejected examples.
SEED_TERMS = ("casino", "pills", "spam", "adult", "bets", "ads", "porn", "viagra", "poker", "lottery")
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:?&=_#%-+@"
OTHER, BEGIN, END = "~", "^", "$"
#: Share of accepted examples that may fall under the cut.
FALSE_REJECTS = 0.002
#: Different URLs of a task.
URLS = 20_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, or nulls."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return name, action


def _grams(urls: DataFrame) -> DataFrame:
    """One row for each symbol of each URL: the symbol after the two before it."""
    text = F.regexp_replace(lower_ascii(F.coalesce(F.col("url"), F.lit(""))), "[^" + ALPHABET.replace("-", r"\-") + "]", OTHER)
    text = F.concat(F.lit(BEGIN * 2), text, F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))
    return urls.where(F.length("url") > 0).select("*", F.explode(grams).alias("gram"))


def train(urls: DataFrame) -> DataFrame:
    """``gram, ratio``: log of accepted over rejected likelihood of a symbol after its context, from ``url, rejected, n``, each URL counting ``n`` times."""
    counts = _grams(urls).groupBy("gram").agg(F.sum(F.when(F.col("rejected"), 0).otherwise(F.col("n"))).alias("acc"), F.sum(F.when(F.col("rejected"), F.col("n")).otherwise(0)).alias("rej"))
    tri = counts.select("gram", F.substring("gram", 1, 2).alias("h2"), F.substring("gram", 2, 1).alias("h1"), F.substring("gram", 3, 1).alias("s"), "acc", "rej")
    one = tri.groupBy("s").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    two = tri.groupBy("h1", "s").agg(F.sum("acc").alias("acc"), F.sum("rej").alias("rej"))
    flat = len(ALPHABET) + 2

    def mixed(counted: DataFrame, context: list[str], below: str | None) -> DataFrame:
        """Adds p_acc and p_rej: this order's estimate mixed with the one below."""
        w = W.partitionBy(*(context or [F.lit(0)]))
        for k in ("acc", "rej"):
            n, kinds = F.sum(k).over(w), F.sum((F.col(k) > 0).cast("int")).over(w)
            lower = F.col(f"{below}_{k}") if below else F.lit(1.0 / flat)
            add = F.greatest(kinds, F.lit(1))
            counted = counted.withColumn(f"p_{k}", (F.col(k) + add * lower) / (n + add))
        return counted

    one = mixed(one, [], None).select("s", F.col("p_acc").alias("one_acc"), F.col("p_rej").alias("one_rej"))
    two = mixed(two.join(one, "s"), ["h1"], "one").select("h1", "s", F.col("p_acc").alias("two_acc"), F.col("p_rej").alias("two_rej"))
    return mixed(tri.join(two, ["h1", "s"]), ["h2"], "two").select("gram", F.log(F.col("p_acc") / F.col("p_rej")).alias("ratio"))


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``url, score`` of URLs that differ: the log-likelihood difference a symbol. Strings the model lacks add nothing."""
    parts = _grams(urls.select("url")).join(F.broadcast(model), "gram", "left")
    return parts.groupBy("url").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("score"))


def cut(scored: DataFrame) -> float:
    """The accepted examples' quantile at FALSE_REJECTS, at most 0; scores are rounded, which bounds the state."""
    counts = scored.where("NOT rejected").groupBy(F.round("score", 3).alias("s")).agg(F.count("*").alias("c"))
    got = counts.agg(F.percentile("s", FALSE_REJECTS, F.col("c"))).first()[0]
    return min(0.0, got if got is not None else 0.0)


def judge(pages: DataFrame, rules=RULES, terms=SEED_TERMS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page."""
    seeded = lower_ascii(F.col("url")).rlike("(^|[^a-z])(" + "|".join(terms) + ")([^a-z]|$)")
    distinct = checkpoint(pages.groupBy("url").agg(F.count("*").alias("n")))
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, distinct.count() // URLS + 1)
    urls = distinct.repartition(tasks).withColumn("rejected", F.coalesce(seeded, F.lit(False)))
    scored = checkpoint(score(urls, train(urls)))
    limit = cut(scored.withColumn("rejected", F.coalesce(seeded, F.lit(False))))
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url").join(scored, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.coalesce("score", F.lit(0.0)).alias("score"))
    name, action = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") < F.lit(limit), "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, own).alias("verdict"), "score")
