"""URL filtering by listed rules and, where none fits, by mined association rules.

Labelled pages are bad if their quality is 0 or they are toxic. Spark's FP-growth mines combinations
of url tokens (labels of the host, segments of the path, names of query parameters) together with
these labels. A rule that ends in the label `block` is kept if it holds for at least `least` bad rows,
whatever the number of rows, if its confidence is at least `lift` times the share of bad rows, and if
that is no accident: by at least `z` standard errors. A rule that holds all tokens of a kept smaller one is dropped. The
rules are matched by an inverted index from the token that the fewest rules hold to the rule;
a rule fires for a url that has all its tokens, and the most confident of those that fire decides.

Only DataFrame and JVM operations are used. Urls are judged once each and joined back, so copies of
one url cost one match. A null url or one without `://` has an empty host and path, no tokens and
the verdict allow; of equally confident rules the smallest and then the last by name counts; repeated
rows get equal results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The rules of the contract: (host, path, verdict).
LISTED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCK, ALLOW = "verdict=block", "verdict=allow"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url; numbers are left out, as they name pages and not kinds of pages."""
    words = lambda c, by, mark: F.transform(F.filter(F.split(c, by), lambda w: (w != "") & ~w.rlike(r"^[0-9]+(\.[a-z]+)?$")), lambda w: F.concat(F.lit(mark), w))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.element_at(F.split(p, "="), 1))
    return F.array_distinct(F.concat(words(host, r"\.", "host="), words(_lower(path), "/", "path="), F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("query="), n))))


def mine(labelled: DataFrame, least: int = 20, lift: float = 1.25, z: float = 2.58, sure: float = 0.5, chance: float = 0.01) -> DataFrame:
    """(rule, tokens, confidence, rare) of each kept rule, from (items) rows that hold tokens and a label; rare is the token to find it by."""
    rows, bad = labelled.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    share = bad / max(1, rows)
    model = FPGrowth(itemsCol="items", predictionCol="p", minSupport=min(1.0, least / max(1, rows)), minConfidence=min(1.0, max(sure, lift * share))).fit(labelled)
    label = F.array(F.lit(BLOCK), F.lit(ALLOW))
    tried = model.freqItemsets.where(~F.arrays_overlap("items", label)).count()
    z = max(z, NormalDist().inv_cdf(1 - chance / max(1, tried)))
    found = model.associationRules.where(F.col("consequent")[0] == BLOCK)
    apart = (F.col("confidence") - share) / F.sqrt(share * (1 - share) * F.col("confidence") / (F.col("support") * rows))
    # none stands out where all rows are bad
    found = found.where(apart >= z) if 0 < share < 1 else found.limit(0)
    found = found.select(F.array_sort("antecedent").alias("tokens"), "confidence")
    # written, since mined rules come in any order and are used several times
    rules = materialize(found.select(F.concat_ws(" ", "tokens").alias("rule"), "tokens", "confidence"), "rules")
    each = rules.select("rule", F.explode("tokens").alias("token"))
    uses = each.groupBy("token").agg(F.count("*").alias("n"))
    rare = each.join(uses, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("rare"))
    rules = materialize(rules.join(rare, "rule"), "rules")
    # a rule within another one is found by its rare token
    inner = rules.select(F.col("rare").alias("token"), F.col("tokens").alias("part"))
    wider = rules.select("rule", "tokens", F.explode("tokens").alias("token")).join(inner, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    return rules.join(wider.select("rule").distinct(), "rule", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules=LISTED, least: int = 20, lift: float = 1.25, z: float = 2.58, sure: float = 0.5, chance: float = 0.01, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) for every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumns(dict(zip(("host", "path"), host_and_path(F.col("url")))))
    rows = rows.withColumns(dict(zip(("rule", "listed"), listed_rule(F.col("host"), F.col("path"), rules))))
    items = tokens(F.col("url"), F.col("host"), F.col("path"))
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    known = labels.select(F.col("doc_id").alias("page_id"), "quality", "toxic").groupBy("page_id").agg(bad.alias("bad")).where("bad is not null")
    marked = F.array(F.when(F.col("bad") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    labelled = rows.where("host != ''").join(known, "page_id").select(F.concat(items, marked).alias("items"))
    index = mine(labelled, least, lift, z, sure, chance).select(F.col("rule").alias("mined_rule"), F.col("tokens").alias("wanted"), "confidence", F.col("rare").alias("token"))
    urls = rows.where("listed is null and host != ''").select("url", "host", "path").distinct()
    open_urls = urls.select("url", items.alias("held")).select("url", "held", F.explode("held").alias("token"))
    fired = open_urls.join(index, "token").where(F.size(F.array_except("wanted", "held")) == 0)
    fired = fired.groupBy("url").agg(F.max(F.struct("confidence", (-F.size("wanted")).alias("size"), "mined_rule")).alias("best"))
    judged = rows.join(fired, "url", "left")
    mined = F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), F.col("best.mined_rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def op5_url_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
