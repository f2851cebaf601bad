"""URL filtering with given rules and with rules mined from labels.

FP-growth finds combinations of URL tokens that go with the label "blocked"; those with enough support and confidence become
rules. Given rules and mined ones stand in one inverted index: a given rule under its host, a mined rule under its rarest
token. A URL looks up its tokens, and what it finds is verified: the path of a given rule, all tokens of a mined one.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import LOWER, UPPER
from caseloom.operators.joins import BROADCAST_BYTES, lookup_join, table_bytes
from caseloom.session import materialize

#: (verdict, host, path): the host and its subdomains, paths that start with the path.
GIVEN = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT, LEAST, CONFIDENCE = 0.005, 8, 0.6
INDEX = "token string, given boolean, verdict string, host string, path string, items array<string>, confidence double, support double"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_tokens(name: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(name, r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    return F.when(name != "", above).otherwise(F.array().cast("array<string>"))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host and domains above, words of the path, keys of the query, a fragment."""
    words = F.regexp_extract_all(F.translate(path(url), UPPER, LOWER), F.lit(r"([^\x00-\x2f\x3a-\x60\x7b-\x7f]+)"))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&]+)"))
    found = F.concat(
        F.array(F.concat(F.lit("s:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        host_tokens(host(url)),
        F.transform(words, lambda w: F.concat(F.lit("p:"), w)),
        F.transform(keys, lambda k: F.concat(F.lit("q:"), k)),
        F.when(url.contains("#"), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mine(
    labelled: DataFrame, url: str = "url", blocked: str = "blocked", support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE
) -> DataFrame:
    """Rules ``items, confidence, support`` whose tokens go with ``blocked``; NULL urls and labels are no evidence.

    ``support`` is a share of the labelled rows, at least ``least`` rows. Tokens of all rows tell nothing and are left out; of
    tokens that stand in the same rows, as the words of a template do, the longest (and last by code point) speaks for all.
    FP-growth runs over the blocked rows; how often its combinations occur in all rows is then counted. A rule is pruned if a
    rule of fewer of its tokens has at least its confidence.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(url).isNotNull() & F.col(blocked).isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), tokens(F.col(url)).alias("items"), F.col(blocked).alias("blocked"))
    rows = materialize(rows.where("size(items) > 0"))
    count, hits = rows.agg(F.count("*"), F.count_if("blocked")).first()
    need = max(least, math.ceil(support * count), 1)
    if hits < need:
        return spark.createDataFrame([], "items array<string>, confidence double, support double")
    each = rows.select("row", "blocked", F.explode("items").alias("token"))
    spoken = materialize(speakers(each, count, need))
    kept = materialize(
        lookup_join(each, spoken.select("token", "seen"), ["token"], ["row"], "inner")
        .groupBy("row", "blocked")
        .agg(F.collect_list("token").alias("items"))  # at most the tokens of a URL
    )
    model = FPGrowth(itemsCol="items", minSupport=need / hits).fit(kept.where("blocked").select("items"))
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq").where(F.col("freq") >= need))
    found = occurrences(sets, kept, spoken).withColumn("confidence", F.col("freq") / F.col("rows"))
    found = materialize(found.where(F.col("confidence") >= confidence))
    rules = found.select("items", "confidence", (F.col("freq") / F.lit(count)).alias("support"))
    return rules.join(pruned(rules).hint("merge"), "items", "left_anti")


def speakers(each: DataFrame, count: int, need: int) -> DataFrame:
    """``token, seen``: tokens that are in ``need`` blocked rows but not in all rows, one for all that share their rows.

    Tokens share their rows if number, sum and exclusive-or of the rows' hashes agree.
    """
    hash = F.xxhash64("row")
    stats = each.groupBy("token").agg(
        F.count("*").alias("seen"), F.count_if("blocked").alias("hits"), F.sum(hash.cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(hash).alias("xor"),
    )
    useful = stats.where((F.col("seen") < count) & (F.col("hits") >= need))
    longest = F.max(F.struct(F.length("token").alias("n"), "token")).getField("token").alias("token")
    return useful.groupBy("seen", "sum", "xor").agg(longest).select("token", "seen")


def occurrences(sets: DataFrame, baskets: DataFrame, spoken: DataFrame) -> DataFrame:
    """Add ``rows``, the number of ``baskets`` that hold all ``items`` of a set; sets are looked up by their rarest token.

    How many sets there are depends on the rows, so no table of sets is broadcast.
    """
    rarest = sets.withColumn("token", F.explode("items")).hint("merge").join(spoken, "token").groupBy("items", "freq")
    keyed = rarest.agg(F.min(F.struct("seen", "token")).getField("token").alias("token"))
    probes = baskets.select(F.col("items").alias("held"), F.explode("items").alias("token"))
    met = probes.join(keyed.hint("merge"), "token").where(F.size(F.array_except("items", "held")) == 0)
    return met.groupBy("items", "freq").agg(F.count("*").alias("rows"))


def pruned(rules: DataFrame) -> DataFrame:
    """The ``items`` of rules for which a rule of some of their tokens has at least their confidence."""
    shorter = rules.select(F.col("items").alias("some"), F.col("confidence").alias("theirs"), F.col("items")[0].alias("token"))
    longer = rules.where("size(items) > 1").withColumn("token", F.explode("items")).join(shorter.hint("merge"), "token")
    held = (F.size("some") < F.size("items")) & (F.size(F.array_except("some", "items")) == 0)
    return longer.where(held & (F.col("theirs") >= F.col("confidence"))).select("items").distinct()


def index(spark: SparkSession, given: tuple, mined: DataFrame) -> DataFrame:
    """The inverted index of both kinds of rules, one posting per rule."""
    listed = spark.createDataFrame(
        [(f"h:{name}", True, verdict, name, start, None, None, None) for verdict, name, start in given], INDEX
    )
    spread = mined.withColumn("token", F.explode("items"))
    common = spread.groupBy("token").agg(F.max("support").alias("seen"))
    rarest = spread.join(common, "token").groupBy("items", "confidence", "support")
    rarest = rarest.agg(F.min(F.struct("seen", "token")).getField("token").alias("token"))
    none = F.lit(None).cast("string")
    found = rarest.select(
        "token", F.lit(False).alias("given"), F.lit("block").alias("verdict"), none.alias("host"), none.alias("path"),
        "items", "confidence", "support",
    )
    return materialize(listed.unionByName(found))


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict, confidence``.

    The longest given rule (host and path together, then host) decides; ``rule`` names it. Without one, the most confident
    mined rule blocks, and no rule allows. NULL urls and those without ``://`` have empty host and path and are allowed.
    Repeated rows are judged each. The index is broadcast if its measured size allows, else both sides are shuffled by token.
    """
    address = F.col(url)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("page_id"), host(address).alias("host"),
        path(address).alias("path"), tokens(address).alias("tokens"),
    )
    probes = rows.withColumn("token", F.explode_outer("tokens"))
    rules = rules.withColumnsRenamed({"host": "rule_host", "path": "rule_path"})
    small = table_bytes(rules.withColumn("items", F.array_join("items", " "))) <= broadcast_bytes
    met = probes.join(F.broadcast(rules) if small else rules, "token", "left")
    # Without a given rule, its columns are NULL and every comparison below is NULL: no match.
    listed = F.when(
        F.col("given") & F.startswith("path", "rule_path"),
        F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
            F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"),
        ),
    )
    mined = F.when(~F.col("given") & (F.size(F.array_except("items", "tokens")) == 0), F.col("confidence"))
    # All rows of a page come from one input row, so the partial maximum leaves one row per page to shuffle.
    found = met.groupBy("row", "page_id", "host", "path").agg(F.max(listed).alias("listed"), F.max(mined).alias("confidence"))
    other = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), other).alias("verdict"), "confidence",
    )
