"""Every rule of the inventory checks, on a small fleet broken in one place at a time."""

import pytest

from dnslens.operators import validation
from dnslens.operators.validation import summary, validate_inventory
from dnslens.schemas import INVENTORY
from dnslens.sources.inventory import load_inventory, read_inventory

FLEET = {
    "dim_deployment": [("fleet-7", None, None, None, None, None, None)],
    "dim_listener": [("fleet-7", 0, "198.51.100.20", "1053", None)],
    "dim_backend": [("fleet-7", 0, "oslo", "203.0.113.30", None, None, "north", None)],
    "dim_region_cidr": [],
    "raw_keys": [],
}


def fleet(spark, **changed):
    return {name: spark.createDataFrame(changed.get(name, FLEET[name]), schema) for name, schema in INVENTORY.items()}


def deployment(**values):
    names = [c.split()[0] for c in INVENTORY["dim_deployment"].split(", ")]
    return [tuple({"config_id": "fleet-7", **values}.get(n) for n in names)]


def found(dims):
    return sorted((r["rule"], r["path"]) for r in validate_inventory(dims).collect())


def test_a_plain_fleet_has_no_problem_and_gets_defaults(spark):
    dims = fleet(spark)
    assert found(dims) == []
    row = summary(dims).first()
    assert (row["policy"], row["timeout"]) == ("round_robin", "800ms")
    assert (row["listeners"], row["backends"], row["regions"]) == (1, 1, 0)


@pytest.mark.parametrize("table,path", [("dim_listener", "listeners"), ("dim_backend", "backends")])
def test_a_whole_section_is_absent(spark, table, path):
    assert found(fleet(spark, **{table: []})) == [("V1", path)]


def test_keys_no_section_knows(spark):
    keys = [("fleet-7", "", ["backends", "colour"]), ("fleet-7", "listeners[3]", ["port", "speed"]), ("fleet-7", "backends[12]", ["site", "owner", "name"])]
    assert found(fleet(spark, raw_keys=keys)) == [("V2", "backends[12].owner"), ("V2", "colour"), ("V2", "listeners[3].speed")]


@pytest.mark.parametrize(
    "column,bad,rule,path",
    [
        ("workers", "257", "V3", "workers"), ("workers", "many", "V3", "workers"), ("admin_port", "65536", "V3", "admin.port"),
        ("log_level", "whisper", "V5", "logging.level"), ("policy", "coin_toss", "V5", "routing.policy"),
        ("admin_address", "203.0.113", "V7", "admin.address"), ("upstream_timeout", "soon", "V6", "upstream.timeout"),
        ("upstream_timeout", "999us", "V6", "upstream.timeout"), ("upstream_timeout", "60001ms", "V6", "upstream.timeout"),
    ],
)
def test_one_bad_value_in_the_deployment(spark, column, bad, rule, path):
    assert found(fleet(spark, dim_deployment=deployment(**{column: bad}))) == [(rule, path)]


def test_values_on_the_limits_pass(spark):
    for values in ({"workers": "256", "admin_port": "65535", "upstream_timeout": "1ms"}, {"workers": "1", "admin_port": "1", "upstream_timeout": "60s"}):
        assert found(fleet(spark, dim_deployment=deployment(**values))) == []


def test_bad_values_in_rows(spark):
    dims = fleet(
        spark,
        dim_listener=[("fleet-7", 4, "198.51.100", "99999", "carrier_pigeon")],
        dim_backend=[("fleet-7", 6, "Oslo!", "203.0.113.1.1", "none", "10001", "-north", None)],
        dim_region_cidr=[("fleet-7", 2, 5, "a b", "203.0.113.64/24")],
    )
    assert found(dims) == [
        ("V3", "backends[6].port"), ("V3", "backends[6].weight"), ("V3", "listeners[4].port"),
        ("V4", "backends[6].name"), ("V4", "backends[6].site"), ("V4", "regions[2].name"),
        ("V5", "listeners[4].transport"),
        ("V7", "backends[6].address"), ("V7", "listeners[4].address"), ("V7", "regions[2].client_cidrs[5]"),
    ]


@pytest.mark.parametrize(
    "table,rows,rule",
    [
        ("dim_listener", [("fleet-7", i, "198.51.100.20", "1053", t) for i, t in enumerate((None, "udp"))], "V8"),
        ("dim_region_cidr", [("fleet-7", i, 0, "inland", f"203.0.{i}.0/24") for i in range(2)], "V10"),
        ("dim_region_cidr", [("fleet-7", i, 0, f"zone{i}", "203.0.112.0/23") for i in range(2)], "V11"),
        ("dim_backend", [("fleet-7", i, "oslo", f"203.0.113.{i}", None, None, "north", None) for i in range(2)], "V12"),
        ("dim_backend", [("fleet-7", i, f"oslo{i}", "203.0.113.9", p, None, "north", None) for i, p in enumerate((None, "53"))], "V13"),
        ("dim_backend", [("fleet-7", i, f"oslo{i}", a, None, None, "north", None) for i, a in enumerate(("fd00::a:0:1", "FD00:0:0:0:0:A:0:1"))], "V13"),
    ],
)
def test_what_occurs_twice(spark, table, rows, rule):
    assert [r for r, _ in found(fleet(spark, **{table: rows}))] == [rule]


def test_a_prefix_inside_another_is_no_repeat(spark):
    nested = [("fleet-7", i, 0, f"zone{i}", f"203.0.112.0/{20 + 2 * i}") for i in range(3)]
    assert found(fleet(spark, dim_region_cidr=nested)) == []


@pytest.mark.parametrize("transport,expected", [("tcp", [("V9", "admin")]), ("udp", []), (None, [])])
def test_the_admin_endpoint_meets_a_listener(spark, transport, expected):
    dims = fleet(
        spark,
        dim_deployment=deployment(admin_address="198.51.100.20", admin_port="7070"),
        dim_listener=[("fleet-7", 0, "198.51.100.20", "7070", transport)],
    )
    assert found(dims) == expected


def test_load_with_defaults(spark, tmp_path):
    for name, df in fleet(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
    loaded = load_inventory(spark, str(tmp_path))
    b = loaded["dim_backend"].first()
    assert (b["port"], b["weight"]) == ("53", "1")
    assert loaded["dim_listener"].first()["transport"] == "udp"
    assert read_inventory(spark, str(tmp_path))["dim_backend"].first()["port"] is None


def test_claimants_of_a_prefix_form_a_chain(spark):
    rows = [("fleet-7", i, c, f"zone{i}", "203.0.112.0/23") for i in range(5) for c in range(2)] + [("fleet-8", 1, 0, "zone1", "203.0.112.0/23")]
    dims = fleet(spark, dim_region_cidr=rows)
    named = validation.named_regions(dims)
    chain = validation._shared_cidrs(named).orderBy("message").collect()
    assert [r.message for r in chain] == [f"203.0.112.0/23: zone{i}, zone{i + 1}" for i in range(4)]
    assert validation._shared_cidrs(named, every_pair=True).count() == 10
    assert [tuple(r) for r in validation.claim_counts(named).collect()] == [("fleet-7", "203.0.112.0/23", 5, 10)]


def test_shared_cidrs_parse_each_prefix_once(spark):
    from dnslens.operators import validation

    def rows(shift):
        return [("c", shift + i, 0, f"r{i}", "10.1.0.0/16") for i in range(3)] + [("c", shift + 3, 0, "r9", "10.1.0.0/8"), ("d", shift, 0, "r0", "10.1.0.0/16")]

    names = "config_id string, region_pos int, cidr_pos int, region string, cidr string"
    met = validation._shared_cidrs(spark.createDataFrame(rows(0), names))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan
    want = ["10.1.0.0/16: r0, r1", "10.1.0.0/16: r1, r2"]
    assert sorted(r["message"] for r in met.collect()) == want
    # Claimants in two spans of positions.
    far = validation._shared_cidrs(spark.createDataFrame(rows(validation.CLAIM_SPAN - 1), names))
    assert sorted(r["message"] for r in far.collect()) == want


def test_ipv6_texts_against_the_standard_library(spark):
    import ipaddress
    import random

    from dnslens.functions.netaddr import normalise_addresses

    rng = random.Random(3)
    texts = ["::", "::1", "1::", ":::", "1:::2", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
             "1:2:3:4::5:6:7:8", "1::3:4:5:6:7:8", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::", "::1.2.3.4", "::1.2.3.256", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", "::ffff:1.2.3.04", "FFFF:ffff:ffff:ffff:ffff:ffff:ffff:ffff", ":", "1:", ":1", "::1\n", "8000::8000:0:0:0"]
    for _ in range(300):
        texts.append("".join(rng.choice([":", "::", "0", "a", "F", "12", "1.2.3.4"]) for _ in range(rng.randrange(1, 14))))
    got = normalise_addresses(spark.createDataFrame([(t,) for t in texts], "x string"), "x", "a").collect()
    for r in got:
        try:
            want = int(ipaddress.IPv6Address(r["x"]))
        except ValueError:
            want = None
        if ":" in r["x"]:
            mine = (r["a_hi"] % 2**64 << 64) + r["a_lo"] % 2**64 if r["a_ok"] else None
            assert mine == want, r["x"]
