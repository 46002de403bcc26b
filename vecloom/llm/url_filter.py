"""URL filters.

Host and path rules decide the URLs that they fit, and label the training data:
two smoothed variable-order character Markov models, of allowed and of blocked
URLs. The others are judged by the difference of the two log-likelihoods over
the URL's length, against a cutoff calibrated on held-out labelled URLs: a fifth
of them is scored by models of the others.

Orders 0 to 2 are folded into one table of K^3 log ratios, whose size depends on
the alphabet only; it reaches the scan as a constant, so scoring needs no
shuffle and no join. DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, aside, table_literal

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&#:%"
#: Symbols: the alphabet from 1 (all digits are 0 to the models), 0 for any other character, the last for the place before the first.
K = len(ALPHABET) + 2
#: Weight of the next lower order in each smoothed estimate, in counts.
BACKOFF = 4.0
#: One labelled URL in so many, by a hash of its text, is held out for the cutoff.
PARTS = 5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ://."""
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substr(url, F.instr(url, F.lit("://")) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The symbols of a URL; none for null."""
    low = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    return F.transform(F.filter(F.split(low, ""), lambda c: c != F.lit("")), lambda c: F.instr(F.lit(ALPHABET), c))


def trigrams(s: Column) -> Column:
    """Index of (symbol before last, last symbol, symbol) at each place of a column of symbols."""

    def moved(by: int) -> Column:
        return F.slice(F.concat(F.array(*[F.lit(K - 1)] * by), s), F.lit(1), F.size(s))

    return F.zip_with(moved(2), F.zip_with(moved(1), s, lambda y, z: y * K + z), lambda x, yz: x * (K * K) + yz)


def log_ratios(labelled: DataFrame) -> DataFrame:
    """One row, one array of K^3 doubles: ln P(allowed) - ln P(blocked) of a symbol after two others. `labelled` has _keys and _rule_verdict."""
    spark = labelled.sparkSession
    seen = labelled.select((F.col("_rule_verdict") == "allow").alias("good"), F.explode("_keys").alias("k"))
    counts = seen.groupBy("k").agg(F.sum(F.col("good").cast("double")).alias("x3"), F.sum((~F.col("good")).cast("double")).alias("y3"))
    grid = spark.range(K**3, numPartitions=1).withColumnRenamed("id", "k")
    cells = grid.join(F.broadcast(counts), "k", "left").fillna(0.0, ["x3", "y3"])
    cells = cells.select("k", "x3", "y3", F.floor(F.col("k") / K).alias("c2"), (F.col("k") % (K * K)).alias("k2"), F.floor(F.col("k") / K % K).alias("c1"), (F.col("k") % K).alias("k1"))

    def sums(by: str, n: str) -> DataFrame:
        return cells.groupBy(by).agg(F.sum("x3").alias("x" + n), F.sum("y3").alias("y" + n))

    for by, n in (("c2", "c2"), ("k2", "2"), ("c1", "c1"), ("k1", "1")):
        cells = cells.join(F.broadcast(sums(by, n)), by)
    total = labelled.agg(F.coalesce(F.sum(F.when(F.col("_rule_verdict") == "allow", F.size("_keys"))), F.lit(0)).cast("double").alias("x"), F.coalesce(F.sum(F.when(F.col("_rule_verdict") == "block", F.size("_keys"))), F.lit(0)).cast("double").alias("y"))

    def p(v: str) -> Column:
        one = (F.col(v + "1") + 1.0) / (total.select(v).scalar() + K)
        two = (F.col(v + "2") + BACKOFF * one) / (F.col(v + "c1") + BACKOFF)
        return (F.col(v + "3") + BACKOFF * two) / (F.col(v + "c2") + BACKOFF)

    out = cells.select("k", F.log(p("x") / p("y")).alias("v"))
    return out.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("ratios"))


def _part(url: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 8), 16, 10).cast("long") % PARTS


def _score(ratios: Column) -> Column:
    return F.when(F.size("_keys") > 0, F.aggregate("_keys", F.lit(0.0), lambda s, k: s + F.element_at(ratios, (k + 1).cast("int"))) / F.size("_keys")).otherwise(0.0)


def _means(labelled: DataFrame, ratios: Column) -> Column:
    """The middle between the classes' mean scores; null if one has no URL."""
    scored = labelled.withColumn("s", _score(ratios))
    means = [F.avg(F.when(F.col("_rule_verdict") == v, F.col("s"))) for v in ("allow", "block")]
    return scored.agg(((means[0] + means[1]) / 2).alias("middle")).select("middle").scalar()


def measured(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """One row (allowed, blocked, allowed_right, blocked_right): the held-out URLs of each class, and those on their side of the cutoff by models of the others."""
    host, path = host_path(F.col(url_col))
    _, verdict = rule_of(host, path, rules)
    labelled = pages.select(verdict.alias("_rule_verdict"), trigrams(symbols(F.col(url_col))).alias("_keys"), _part(F.col(url_col)).alias("_part")).filter("_rule_verdict is not null")
    ratios, held = table_literal(log_ratios(labelled.filter("_part != 0"))), labelled.filter("_part = 0")
    good, above = F.col("_rule_verdict") == "allow", _score(ratios) >= _means(held, ratios)
    return held.agg(F.count_if(good).alias("allowed"), F.count_if(~good).alias("blocked"), F.count_if(good & above).alias("allowed_right"), F.count_if(~good & ~above).alias("blocked_right"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Every row with host, path, rule, score and verdict; columns of these names are replaced.

    score is the log-likelihood difference per character, 0 for a null or empty
    URL. The verdict is the rule's, else allow if the score reaches the cutoff,
    the mean of the two classes' mean scores on held-out URLs; on all labelled
    ones, if those that are held out lack a class. Where no rule fits any URL, or
    only rules of one verdict do, there is nothing to tell apart and the others
    are allowed. Repeated rows count as often as they occur; an empty table gives
    an empty result. Other columns pass through whatever their names.
    """
    pages, back = aside(pages.drop("host", "path", "rule", "score", "verdict"), "_rule_verdict", "_symbols", "_keys")
    url_col = {old: new for new, old in back.items()}.get(url_col, url_col)
    host, path = host_path(F.col(url_col))
    keyed = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keyed = keyed.withColumn("rule", rule).withColumn("_rule_verdict", verdict).withColumn("_symbols", symbols(F.col(url_col))).withColumn("_keys", trigrams(F.col("_symbols"))).drop("_symbols")
    labelled = keyed.filter(F.col("_rule_verdict").isNotNull()).select("_rule_verdict", "_keys", _part(F.col(url_col)).alias("_part"))
    ratios = table_literal(log_ratios(labelled))
    held = _means(labelled.filter("_part = 0"), table_literal(log_ratios(labelled.filter("_part != 0"))))
    cutoff = F.coalesce(held, _means(labelled, ratios), F.lit(float("-inf")))
    return keyed.withColumn("score", _score(ratios)).withColumn("verdict", F.coalesce("_rule_verdict", F.when((F.col("score") >= cutoff) | (F.size("_keys") == 0), F.lit("allow")).otherwise("block"))).drop("_rule_verdict", "_keys").withColumnsRenamed(back)
