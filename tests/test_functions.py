"""Column functions against the C library, ``ipaddress`` and plain arithmetic, over generated texts."""

import ipaddress
import random
import socket

from pyspark.sql import functions as F

from dnslens.functions.durations import duration_text, normalise_durations
from dnslens.functions.histogram import bucket_lower, bucket_mid, bucket_of, bucket_upper
from dnslens.functions.netaddr import client_prefix, normalise_addresses, normalise_cidrs

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000}


def libc(text):
    for family in (socket.AF_INET, socket.AF_INET6):
        try:
            return socket.inet_ntop(family, socket.inet_pton(family, text))
        except (OSError, ValueError):
            pass
    return None


def some_address(rng):
    """An address of either family, in compressed or full spelling."""
    if rng.random() < 0.4:
        return str(ipaddress.IPv4Address(rng.getrandbits(32)))
    bits = rng.getrandbits(128) & rng.choice([(1 << 128) - 1, ~0 << 64, 0xFFFF, ~0xFFFF0000 << 48]) % (1 << 128)
    address = ipaddress.IPv6Address(bits % (1 << 128))
    return rng.choice([address.compressed, address.exploded, address.compressed.upper()])


def damaged(rng, text):
    """The text with one character dropped, doubled, replaced or put in."""
    i = rng.randrange(len(text))
    new = rng.choice(":./%- gx09\t\n")
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + text[i] + text[i:], text[:i] + new + text[i + 1 :], text[:i] + new + text[i:]])


def assembled(rng):
    """Groups put together with little regard for the rules."""
    groups = [rng.choice(["0", "0", f"{rng.randrange(65536):x}", f"{rng.randrange(65536):04X}"]) for _ in range(8)]
    i = rng.randrange(8)
    j = rng.randrange(i, 9)
    return rng.choice([
        ":".join(groups[: rng.randrange(1, 9)]),
        ":".join(groups[:i]) + "::" + ":".join(groups[j:]),
        ":".join(groups[:6]) + ":" + ".".join(str(rng.randrange(300)) for _ in range(4)),
        ".".join(str(rng.randrange(270)) for _ in range(rng.randrange(3, 6))),
    ])


def test_addresses_agree_with_the_c_library(spark):
    rng = random.Random(11)
    good = [some_address(rng) for _ in range(200)]
    texts = sorted({*good, *(damaged(rng, t) for t in good * 2), *(assembled(rng) for _ in range(300)), ""})
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    got = {r["a"]: r for r in normalise_addresses(rows, "a").collect()}
    known = {t: libc(t) if "\n" not in t else None for t in texts}
    assert {t: r["addr_text"] for t, r in got.items()} == known
    assert {t: r["addr_ok"] for t, r in got.items()} == {t: x is not None for t, x in known.items()}
    assert 200 <= sum(x is not None for x in known.values()) < len(texts) - 100


def test_cidrs(spark):
    rng = random.Random(12)
    expected = {}
    for _ in range(150):
        address = ipaddress.ip_address(some_address(rng))
        width = address.max_prefixlen
        length = rng.randrange(width + 1)
        network = ipaddress.ip_network((int(address) >> (width - length) << (width - length), length)
                                       if address.version == 4 else f"{ipaddress.IPv6Address(int(address) >> (width - length) << (width - length))}/{length}")
        expected[str(network)] = None
        expected[f"{address}/{length}"] = None if address == network.network_address else "host_bits_set"
        expected[str(address)] = "missing_slash"
        expected[f"{network.network_address}/{width + 1 + rng.randrange(60)}"] = "too_long"
        expected[f"{network.network_address}/{rng.choice(['', 'seven', f'{length}?', f'-{length}', '8' * 14])}"] = "bad_length"
        expected[f"{str(address).replace('1', 'z').replace(':', ';')}q/{length}"] = "bad_address"
    rows = spark.createDataFrame([(t,) for t in expected], "c string")
    got = {r["c"]: r for r in normalise_cidrs(rows, "c", "net").collect()}
    assert {t: r["net_error"] for t, r in got.items()} == expected
    assert all((r["net"] is None) == (r["net_error"] is not None) for r in got.values())


def test_durations(spark):
    rng = random.Random(13)
    expected = {}
    for unit, factor in UNITS.items():
        for n in (0, *(rng.randrange(10 ** rng.randrange(1, 7)) for _ in range(12))):
            text = f"{n}{unit}"
            expected[text] = n * factor
            for wrong in (f"{n}", unit, f"{n} {unit}", f"-{text}", f"+{text}", f"{text}{unit}?", f"{n}.5{unit}", f"{n}{unit}\n", f"{n}d", f"{'7' * 20}{unit}"):
                expected[wrong] = None
    expected[""] = None
    rows = spark.createDataFrame([(t,) for t in expected], "d string")
    got = {r["d"]: r["us"] for r in normalise_durations(rows, "d").collect()}
    assert got == expected
    values = [3 * UNITS["s"], 45 * UNITS["ms"], 7_001]
    shown = spark.createDataFrame([(x,) for x in values], "us long").select(duration_text(F.col("us"))).collect()
    assert [r[0] for r in shown] == ["3s", "45ms", "7001us"]


def test_histogram_error_is_bounded(spark):
    values = spark.range(1, 10_000_001, 997).withColumn("b", bucket_of(F.col("id")))
    bad = values.filter(
        (bucket_lower(F.col("b")) > F.col("id"))
        | (bucket_upper(F.col("b")) <= F.col("id"))
        | (F.abs(bucket_mid(F.col("b")) - F.col("id")) / F.col("id") > 0.0079)
    )
    assert bad.count() == 0


def test_prefixes(spark):
    rng = random.Random(14)
    expected = {}
    for _ in range(60):
        address = ipaddress.ip_address(some_address(rng))
        host = address.max_prefixlen - (24 if address.version == 4 else 56)
        kept = int(address) >> host << host
        net = ipaddress.IPv4Address(kept) if address.version == 4 else ipaddress.IPv6Address(kept)
        expected[str(address)] = f"{libc(str(net))}/{address.max_prefixlen - host}"
    rows = spark.createDataFrame([(t,) for t in expected], "a string")
    got = {r["a"]: r["prefix"] for r in client_prefix(normalise_addresses(rows, "a", "client")).collect()}
    assert got == expected
