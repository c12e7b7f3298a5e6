"""Taxonomy groups and their prefixes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The eleven taxonomy groups and the prefixes that belong to them.
TAXONOMY_GROUPS = {
    "Unknown": ["unk", "empty"],
    "Other": ["ttl_error", "hostout", "netout", "icmp_error"],
    "HTTP": ["alphflHTTP", "ptmpHTTP", "mptpHTTP", "ptmplaHTTP", "mptplaHTTP"],
    "MultiPoints": ["ptmp", "mptp", "mptmp"],
    "AlphaFlow": ["alphfl", "malphfl", "salphfl", "point_to_point", "heavy_hitter"],
    "IPv6Tunneling": ["ipv4gretun", "ipv46tun"],
    "PortScan": ["posca", "ptpposca"],
    "NetworkScanICMP": ["ntscIC", "dntscIC"],
    "NetworkScanUDP": ["ntscUDP", "ptpposcaUDP"],
    "NetworkScanTCP": [
        "ntscACK", "ntscSYN", "sntscSYN", "ntscTCP", "ntscnull", "ntscXmas", "ntscFIN", "dntscSYN",
    ],
    "DoS": ["DoS", "distributed_dos", "ptpDoS", "sptpDoS", "DDoS", "rflat"],
}


def taxonomy_groups(spark: SparkSession) -> DataFrame:
    """(category, prefixes): the fixed eleven rows."""
    return spark.createDataFrame(list(TAXONOMY_GROUPS.items()), "category string, prefixes array<string>")


def taxonomy_prefixes(spark: SparkSession) -> DataFrame:
    """(taxonomy, category), one row per prefix: 39 rows, always small enough to broadcast."""
    return taxonomy_groups(spark).select(F.explode("prefixes").alias("taxonomy"), "category")
