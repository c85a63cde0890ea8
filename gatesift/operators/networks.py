"""Addresses against a table of networks: the longest prefix that covers an address decides.

An address is inside a network of `b` bits when both agree in their first `b` bits. So an address is expanded to one key
per prefix length that occurs in the table, at most 33 for IPv4 and 129 for IPv6, and the keys are joined by equality:
no range comparison and no cross join, however many networks there are. Equal addresses are judged once, so an address
which a third of all rows have is one row in the join. Spark broadcasts the table where its size check allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.expr import let
from gatesift.functions.net import parse_ipv4, parse_ipv6

MAPPED = "0" * 80 + "1" * 16  # first bits of an IPv6 address that holds an IPv4 address


def address_bits(address: Column) -> Column:
    """The bits of an address as text with its family in front: `4` and 32 bits, `6` and 128; NULL for what is none.

    An IPv4 address inside an IPv6 one (`::ffff:10.0.0.1`) has the bits of the IPv4 address. A zone is ignored.
    """
    host = F.regexp_replace(F.regexp_replace(address, r"\A\[|\]\z", ""), "%.*", "")
    four = let(parse_ipv4(host), lambda n: F.when(n.isNotNull(), F.concat(F.lit("4"), F.lpad(F.conv(n.cast("string"), 10, 2), 32, "0"))))
    joined = let(
        parse_ipv6(host),
        lambda g: F.when(g.isNotNull(), F.array_join(F.transform(g, lambda x: F.lpad(F.conv(x.cast("string"), 10, 2), 16, "0")), "")),
    )
    six = let(joined, lambda b: F.when(F.startswith(b, F.lit(MAPPED)), F.concat(F.lit("4"), F.substring(b, 97, 32))).otherwise(F.concat(F.lit("6"), b)))
    return F.when(F.contains(host, F.lit(":")), six).otherwise(four)


def network_prefix(network: Column) -> Column:
    """Family and leading bits of `address/bits`, or of a bare address; NULL for what is no network. Bits behind the prefix are ignored."""
    whole = address_bits(F.split_part(network, F.lit("/"), F.lit(1)))
    given = F.when(F.contains(network, F.lit("/")), F.regexp_extract(network, r"\A[^/]*/([0-9]{1,3})\z", 1).try_cast("int"))
    mapped = F.contains(network, F.lit(":")) & F.startswith(whole, F.lit("4"))

    def cut(bits: Column) -> Column:
        size = F.char_length(bits) - 1
        wanted = F.when(~F.contains(network, F.lit("/")), size).otherwise(F.when(mapped, given - 96).otherwise(given))
        return F.when((wanted >= 0) & (wanted <= size), F.substring(bits, F.lit(1), wanted + 1))

    return let(whole, cut)


def network_table(networks: DataFrame, network: str, label: str) -> DataFrame:
    """One row per network: `prefix`, `network`, `label`. Of rows for the same network the smallest label, then text, counts.

    A NULL label is kept, and counts before others. Rows that are no network fail, so that a deny list with a slip is not silently shorter.
    """
    prefix = network_prefix(F.col(network))
    wrong = F.raise_error(F.concat(F.lit("not a network: "), F.coalesce(F.col(network), F.lit("NULL"))))
    rows = networks.select(F.coalesce(prefix, wrong.cast("string")).alias("prefix"), F.col(label).alias("label"), F.col(network).alias("network"))
    best = rows.groupBy("prefix").agg(F.min(F.struct("label", "network")).alias("_best"))
    return best.select("prefix", "_best.network", "_best.label")


def match_networks(df: DataFrame, address: str, networks: DataFrame, network: str = "network", label: str = "label") -> DataFrame:
    """The input with `matched_network`, `matched_label` and `prefix_bits` of the longest network that holds the address; NULL for none.

    No row is lost or doubled: addresses that are NULL or no address match nothing, and columns of the input may have any
    name but these three and `_network_address`, `_network_found`. An empty table of networks matches nothing. The join back to the
    rows has one row per address on its other side; a hot address, and NULL, is split by Spark's skew join.
    """
    table = network_table(networks, network, label)
    lengths = table.select(F.substring("prefix", 1, 1).alias("_family"), F.char_length("prefix").alias("_length")).groupBy("_family").agg(
        F.array_sort(F.collect_set("_length")).alias("_lengths")  # at most 33 or 129 numbers
    )
    distinct = df.select(F.col(address).alias("_network_address")).filter(F.col("_network_address").isNotNull()).distinct()
    bits = distinct.select("_network_address", address_bits(F.col("_network_address")).alias("_bits")).filter(F.col("_bits").isNotNull())
    # Two families, so at most two rows.
    sized = bits.join(F.broadcast(lengths), F.substring("_bits", 1, 1) == F.col("_family"))
    keys = sized.select("_network_address", F.explode(F.transform("_lengths", lambda n: F.substring(F.col("_bits"), F.lit(1), n))).alias("_prefix"))
    found = keys.join(table, F.col("_prefix") == F.col("prefix")).groupBy("_network_address").agg(
        F.max_by(F.struct("network", "label", (F.char_length("prefix") - 1).alias("bits")), F.char_length("prefix")).alias("_network_found")
    )
    rows = df.join(found, F.col(address) == F.col("_network_address"), "left")
    return rows.select(
        *(df[f"`{c}`"] for c in df.columns), F.col("_network_found.network").alias("matched_network"), F.col("_network_found.label").alias("matched_label"),
        F.col("_network_found.bits").alias("prefix_bits"),
    )
