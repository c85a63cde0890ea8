"""Longest prefixes against a loop over all networks."""

import ipaddress
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gatesift.functions import net
from gatesift.operators import networks as N


def longest(address, table):
    try:
        a = ipaddress.ip_address((address or "").split("%")[0].strip("[]"))
    except ValueError:
        return None, None
    a = getattr(a, "ipv4_mapped", None) or a
    held = [(n.prefixlen, text) for text, n in table if n.version == a.version and a in n]
    return max(held)[::-1] if held else (None, None)


def random_address(rng):
    if rng.random() < 0.6:
        return f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}"
    return f"2001:db8:{rng.randrange(3):x}::{rng.randrange(65536):x}"


def test_like_a_loop(spark):
    rng = random.Random(5)
    seen = {}
    for _ in range(400):
        a = random_address(rng)
        n = ipaddress.ip_network(f"{a}/{rng.randrange(8, 33 if '.' in a else 129)}", strict=False)
        seen.setdefault(n, str(n))
    for text in ("0.0.0.0/0", "::/0"):
        if rng.random() < 0.5:
            seen[ipaddress.ip_network(text)] = text
    table = [(text, n) for n, text in seen.items()]
    odd = [None, "", "host", "10.0.0.256", "010.0.0.1", "::ffff:10.1.2.3", "[2001:db8::1]", "fe80::1%eth0", "1.2.3.4", "10.0.0.1:80"]
    addresses = [random_address(rng) for _ in range(1500)] + odd + ["10.1.1.1"] * 500
    df = spark.createDataFrame([(a, i, "clash", "clash") for i, a in enumerate(addresses)], "address string, i int, label string, prefix string")
    nets = spark.createDataFrame([(text, text) for text, _ in table], "network string, label string")
    got = N.match_networks(df, "address", nets).collect()
    assert len(got) == len(addresses)
    for r in got:
        assert (r["matched_network"], r["prefix_bits"]) == longest(r["address"], table), r
        assert r["label"] == "clash" and addresses[r["i"]] == r["address"]


def test_plan_has_no_cross_join(spark):
    df = spark.range(10).select(F.lit("10.0.0.1").alias("address"))
    nets = spark.createDataFrame([("10.0.0.0/8", "x")], "network string, label string")
    plan = N.match_networks(df, "address", nets)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_same_network_twice_and_slips(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", "b"), ("10.9.9.9/8", "a"), ("::ffff:10.1.0.0/112", "c")], "network string, label string")
    df = spark.createDataFrame([("10.0.0.1",), ("10.1.0.1",), ("11.0.0.1",)], "address string")
    assert [tuple(r) for r in N.match_networks(df, "address", nets).orderBy("address").collect()] == [
        ("10.0.0.1", "10.9.9.9/8", "a", 8), ("10.1.0.1", "::ffff:10.1.0.0/112", "c", 16), ("11.0.0.1", None, None, None),
    ]
    for slip in ("10.0.0.0/33", "10.0.0.0/x", "host", None, "::/129", "10.0.0.0/"):
        with pytest.raises(PySparkException, match="not a network"):
            N.match_networks(df, "address", spark.createDataFrame([(slip, "x")], "network string, label string")).collect()
    assert [r["matched_label"] for r in N.match_networks(df, "address", nets.limit(0)).collect()] == [None] * 3


def test_the_fixed_ranges_as_a_table(spark):
    """A table of the ranges that are refused gives what the fixed expression gives."""
    ranges = "0.0.0.0/8 10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 224.0.0.0/3 ::/127 fe80::/10 fc00::/7".split()
    rng = random.Random(3)
    first = [0, 10, 127, 169, 172, 192, 223, 224, 255, 8]
    v4 = [f"{rng.choice(first)}.{rng.choice([0, 16, 31, 32, 168, 254])}.{rng.randrange(256)}.1" for _ in range(600)]
    v6 = ["::", "::1", "::2", "fe80::1", "fec0::1", "fc00::1", "fdff::1", "fe00::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8"]
    df = spark.createDataFrame([(a,) for a in v4 + v6], "address string")
    nets = spark.createDataFrame([(r, "unsafe") for r in ranges], "network string, label string")
    out = N.match_networks(df, "address", nets).withColumn("fixed", net.unsafe_address(F.col("address"))).collect()
    assert len(out) == len(v4 + v6)
    for r in out:
        assert (r["matched_label"] is not None) == r["fixed"], r


def test_a_hundred_thousand_networks(spark):
    step = F.col("id") * 40_503 % 16_777_216
    dotted = F.concat_ws(".", *(F.shiftright(step, s).bitwiseAND(255).cast("string") for s in (16, 8, 0)), F.lit("0"))
    nets = spark.range(100_000).select(F.concat(dotted, F.lit("/24")).alias("network"), F.col("id").cast("string").alias("label"))
    df = spark.range(0, 100_000, 10).select("id", F.concat(F.regexp_replace(dotted, "0$", ""), F.lit("77")).alias("address"))
    got = N.match_networks(df, "address", nets)
    assert got.filter(F.col("matched_label") == F.col("id").cast("string")).count() == 10_000
