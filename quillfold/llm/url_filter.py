"""URL filters by hashed host-suffix and path-prefix expressions; DataFrame operations only.

A URL expands into (host suffix, path prefix) expressions: each suffix of the host that starts at a label and has no
more labels than the longest rule's host, with each prefix of the path whose length some rule has. Expressions and rules meet on a short prefix of
their SHA-256; a match counts only if the full digests agree, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast if they have so many bytes at most, digests included.
BROADCAST_BYTES, RULE_BYTES = 20 << 20, 200


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most: int) -> Column:
    """The host's last labels, up to ``most`` of them, and fewer."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def expression_digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    Null URLs and those without :// have an empty host and path. A rule fits its host and all subdomains if
    the path starts with the rule's path. The longest wins: by host, then by path; of equal rules given
    twice, the last verdict in the alphabet (block) wins. Without a rule, rule is null and the verdict is
    ``default``. Repeated rows stay as often as given; null ids stay null; other columns are ignored. Hosts
    or paths with empty labels are taken as they are. Very long URLs are whole. An empty table gives no rows.
    """
    spark = pages.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    table = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    digest = expression_digest(F.col("host"), F.col("path"))
    table = table.select(
        digest.alias("rule_digest"),
        F.substring(digest, 1, prefix_digits).alias("short"),
        F.struct(F.length("host").alias("of_host"), F.length("path").alias("of_path"), "verdict", F.concat("host", "path").alias("rule")).alias("found"),
    )
    if sum(RULE_BYTES + 4 * len(r.verdict + r.host + r.path) for r in rules) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    tails = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    heads = F.transform(tails, lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(host_suffixes(F.col("host"), max([1, *(r.host.count(".") + 1 for r in rules)])), lambda h: F.transform(heads, lambda p: expression_digest(h, p))))
    exploded = base.withColumn("digest", F.explode_outer(pairs)).withColumn("short", F.substring("digest", 1, prefix_digits))
    matched = exploded.join(table, "short", "left").withColumn("found", F.when(F.col("digest") == F.col("rule_digest"), F.col("found")))
    best = matched.groupBy("row", "page_id", "host", "path").agg(F.max("found").alias("found"))
    return best.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
