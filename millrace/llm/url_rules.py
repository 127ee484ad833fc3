"""URL rules by host suffix and path prefix, met through short hash prefixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower
from millrace.plans.skew import at_most, spread_join

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PREFIX_HEX = 8  # hex digits of the digest that the join goes by: 32 bits
BROADCAST_RULES = 20_000  # rules up to this count are broadcast: about 3 MB of digests and names
MAX_SHAPES = 4_096  # pairs of (host labels, path characters) among the rules


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, allow or block)."""
    structs = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the longest rule that fits each url: ``page_id, url, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict`` (allow or block). A rule fits its host and all subdomains where the url's
    path starts with the rule's. Each url is expanded into those (host suffix, path prefix) expressions whose
    shape, labels and characters, some rule has; expressions meet rules on 32 bits of their digest, and the whole
    digest confirms. Of the rules that fit, the one with the most characters wins, block before allow on a tie;
    urls without one get ``default`` and a null ``rule``.

    A url that is null or has no ``://`` has an empty host and path. Rules with a null part fit nothing. Null ids
    and repeated rows are kept, each with its verdict. Extra columns are ignored; empty tables give no rows, or
    ``default`` for all. The one shuffle carries a url per page and its fitting rules, and folds repeats before it.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict")
    ).where("host is not null and path is not null and verdict is not null")
    shape = [F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars")]
    shapes = rules.select(*shape).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"rules have more than {MAX_SHAPES} shapes")
    made = F.array(*(F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["chars"]).alias("chars")) for s in shapes))

    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    named = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels, chars = F.size(F.split("host", "\\.")), F.length("path")
    if shapes:
        fitting = F.filter(made, lambda s: (s["labels"] <= labels) & (s["chars"] <= chars))
        digests = F.transform(
            fitting,
            lambda s: _digest(
                F.array_join(F.slice(F.split("host", "\\."), labels - s["labels"] + 1, s["labels"]), "."),
                F.substring("path", F.lit(1), s["chars"]),
            ),
        )
    else:
        digests = F.array().cast("array<string>")
    # The empty expression stands for the page itself, so that pages without a rule stay.
    expressions = named.select("*", F.explode(F.concat(F.array(F.lit("")), digests)).alias("digest"))
    expressions = expressions.withColumn("short", F.substring("digest", 1, PREFIX_HEX))

    listed = (
        rules.withColumn("digest", _digest(F.col("host"), F.col("path")))
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.concat("host", "path").alias("rule"))).getField("rule").alias("rule"),
            F.max("verdict").alias("verdict"),
        )
        .select("digest", "rule", "verdict", F.substring("digest", 1, PREFIX_HEX).alias("short"))
        .withColumnRenamed("digest", "rule_digest")
    )
    if at_most(listed, BROADCAST_RULES):
        met = expressions.join(F.broadcast(listed), "short", "left")
    else:
        met = spread_join(expressions, listed, "short", "page_id", "left")
    fits = F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct(F.length("rule").alias("chars"), F.col("verdict"), F.col("rule")),
    )
    met = met.withColumn("fit", fits).where((F.col("digest") == "") | F.col("fit").isNotNull())
    best = met.groupBy("page_id", "url", "host", "path").agg(
        F.max("fit").alias("fit"), F.count_if(F.col("digest") == "").alias("copies")
    )
    return best.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
