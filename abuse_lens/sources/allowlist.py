"""Allowlist of addresses and CIDR blocks, and membership against it.

An address is kept as a /32 row with ``kind = 'ip'``.  Membership is an
equi-join on (prefix length, network), never a range loop; Spark broadcasts a
list that it measures to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abuse_lens.functions import net

SCHEMA = "kind string, network bigint, prefix_len int"


def parse_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines to allowlist rows; a malformed line fails the query.

    Blank lines and lines starting with ``#`` are skipped.  A line with a slash
    is a CIDR (host bits are masked away), any other line one address.
    """
    text = F.trim("value")
    part = F.split(F.col("line"), "/")
    address = net.ipv4_to_long(F.when(F.col("cidr"), part.getItem(0)).otherwise(F.col("line")))
    prefix = F.when(~F.col("cidr"), F.lit(32)).when(
        (F.size(part) == 2) & F.element_at(part, -1).rlike(r"^\+?\d{1,3}$"), F.element_at(part, -1).cast("int")
    )
    good = F.col("address").isNotNull() & F.col("prefix_len").between(0, 32)
    return (
        lines.select(text.alias("line"))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("cidr", F.col("line").contains("/"))
        .select("line", F.when(F.col("cidr"), "cidr").otherwise("ip").alias("kind"), address.alias("address"), prefix.alias("prefix_len"))
        .select(
            F.when(good, F.col("kind"))
            .otherwise(F.raise_error(F.concat(F.lit("malformed allowlist line: "), F.col("line"))))
            .alias("kind"),
            net.cidr_network(F.col("address"), F.col("prefix_len")).alias("network"),
            F.col("prefix_len").cast("int").alias("prefix_len"),
        )
    )


@dataclass(frozen=True)
class Allowlist:
    """Allowlist rows, the (at most 33) prefix lengths in use, and how many entries there are."""

    table: DataFrame
    prefixes: tuple[int, ...]
    ip_count: int
    cidr_count: int


def load(spark: SparkSession, path: str) -> Allowlist:
    return from_table(parse_lines(spark.read.text(path)))


def from_lines(spark: SparkSession, lines: list[str]) -> Allowlist:
    """An allowlist given in code; a long one belongs in a file."""
    texts = F.array(*[F.lit(line) for line in lines]) if lines else F.array().cast("array<string>")
    return from_table(parse_lines(spark.range(0, 1, 1, 1).select(F.explode(texts).alias("value"))))


def empty(spark: SparkSession) -> Allowlist:
    return Allowlist(spark.range(0).selectExpr("'ip' kind", "id network", "32 prefix_len"), (), 0, 0)


def from_table(table: DataFrame) -> Allowlist:
    """An allowlist of rows; one summary row reaches the driver."""
    summary = table.agg(
        F.array_sort(F.collect_set("prefix_len")).alias("prefixes"),
        F.count_distinct(F.when(F.col("kind") == "ip", F.col("network"))).alias("ips"),
        F.sum((F.col("kind") == "cidr").cast("bigint")).alias("cidrs"),
    ).first()
    ips, cidrs = summary["ips"] or 0, summary["cidrs"] or 0
    return Allowlist(table, tuple(summary["prefixes"] or ()), ips, cidrs)


def allowed_addresses(ips: DataFrame, allow: Allowlist, ip: str = "ip_u32") -> DataFrame:
    """Distinct addresses of ``ips`` inside the allowlist, by equi-join.

    Each distinct address is widened to one row per prefix length in use (at
    most 33) and semi-joined on (prefix length, network).
    """
    lengths = F.array(*[F.lit(p) for p in allow.prefixes]) if allow.prefixes else F.array().cast("array<int>")
    networks = allow.table.select("prefix_len", "network").distinct()
    return (
        ips.select(ip)
        .distinct()
        .select(ip, F.explode(lengths).alias("prefix_len"))
        .withColumn("network", net.cidr_network(F.col(ip), F.col("prefix_len")))
        .join(networks, ["prefix_len", "network"], "left_semi")
        .select(ip)
        .distinct()
    )


def with_allow_flag(df: DataFrame, allow: Allowlist, ip: str = "ip_u32", into: str = "allowlisted") -> DataFrame:
    """Add a boolean: is the row's address allowlisted?  A null address is not.

    One join per prefix length, each against that length's networks, so ``df`` is
    read once.
    """
    hit = F.lit(False)
    for length in allow.prefixes:
        networks = allow.table.where(F.col("prefix_len") == length).select(F.col("network").alias("_net")).distinct()
        df = df.withColumn("_masked", net.cidr_network(F.col(ip), F.lit(length)))
        found = networks.withColumn(f"_hit{length}", F.lit(True))
        df = df.join(found, F.col("_masked") == F.col("_net"), "left").drop("_masked", "_net")
        hit = hit | F.col(f"_hit{length}").isNotNull()
    return df.withColumn(into, hit).drop(*[f"_hit{length}" for length in allow.prefixes])


def exceptions(allow: Allowlist) -> DataFrame:
    """Allowlist as rule exceptions with their document order (``rank``, ``network``, ``prefix_len``)."""
    cidr = F.col("kind") == "cidr"
    address = net.long_to_ipv4(F.col("network"))
    ips = allow.table.where(~cidr).distinct()
    return ips.unionByName(allow.table.where(cidr)).select(
        cidr.cast("int").alias("rank"),
        "network",
        "prefix_len",
        F.when(cidr, "src_cidr").otherwise("src_ip").alias("key_type"),
        F.when(cidr, F.concat(address, F.lit("/"), F.col("prefix_len").cast("string"))).otherwise(address).alias("key_value"),
    )
