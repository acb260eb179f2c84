"""IP address and CIDR columns, computed with JVM expressions only.

An address becomes ``struct<family, hi, lo>``: IPv4 lives in ``lo`` (0..2^32-1) with
``hi`` = 0, IPv6 is split in two 64-bit halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TEXT = 46

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$"

_HEX = "[0-9a-fA-F]{1,4}"
_V6_WHOLE = f"^{_HEX}(:{_HEX}){{7}}$"
# At most seven groups in all around the gap; their number follows from the colons.
_V6_SIDE = f"({_HEX}(:{_HEX}){{0,6}})?"
_V6_GAP = f"^{_V6_SIDE}::{_V6_SIDE}$"

# The expressions below are SQL text: `transform(array(x), v -> ...)[0]` binds a value to a
# name, so that using it often does not repeat its expression.


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def v4_number_sql(text: str) -> str:
    """Dotted quad to number; null for anything else (leading zeros are refused)."""
    octets = (
        f"substring_index({text}, '.', 1)", f"substring_index(substring_index({text}, '.', 2), '.', -1)",
        f"substring_index(substring_index({text}, '.', -2), '.', 1)", f"substring_index({text}, '.', -1)",
    )
    number = " + ".join(f"cast({o} AS BIGINT) * {1 << s}" for o, s in zip(octets, (24, 16, 8, 0)))
    return f"CASE WHEN rlike({text}, '{_V4}') AND NOT contains({text}, '\n') THEN {number} END"


def v4_text_sql(number: str) -> str:
    """Number to dotted quad."""
    octets = ", ".join(f"cast(shiftright({number}, {s}) & 255 AS STRING)" for s in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def _v6_digits_sql(text: str) -> str:
    """The 32 hex digits of an IPv6 address, or null if malformed."""
    # A trailing dotted quad stands for the last two groups.
    tail = _let(
        v4_number_sql(f"substring_index({text}, ':', -1)"),
        "n",
        f"concat(regexp_replace({text}, '[^:]*$', ''), lower(hex(shiftright(n, 16))), ':', lower(hex(n & 65535)))",
    )
    plain = f"CASE WHEN contains(substring_index({text}, ':', -1), '.') THEN {tail} ELSE {text} END"
    # Groups that stand in the text: a colon each, but for the two of the gap.
    given = "length(p) - length(replace(p, ':', '')) - CASE WHEN startswith(p, '::') THEN 1 ELSE 0 END - CASE WHEN endswith(p, '::') THEN 1 ELSE 0 END"
    zeros = "substring(':0:0:0:0:0:0:0:0', 1, 2 * (8 - n))"
    left, right = "substring_index(p, '::', 1)", "substring_index(p, '::', -1)"
    filled = (
        f"CASE WHEN n <= 7 THEN concat(CASE WHEN startswith(p, '::') THEN '' ELSE concat(':', {left}) END, {zeros}, "
        f"CASE WHEN endswith(p, '::') THEN '' ELSE concat(':', {right}) END) END"
    )
    groups = f"CASE WHEN rlike(p, '{_V6_WHOLE}') THEN concat(':', p) WHEN rlike(p, '{_V6_GAP}') THEN {_let(given, 'n', filled)} END"
    # Every group with three zeros before it, of which its last four digits are kept.
    digits = f"regexp_replace(replace({groups}, ':', ':000'), ':[0-9a-fA-F]{{0,3}}([0-9a-fA-F]{{4}})(?![0-9a-fA-F])', '$1')"
    return (
        f"CASE WHEN contains({text}, ':') AND NOT contains({text}, '\n') AND length({text}) <= {MAX_TEXT} "
        f"THEN {_let(plain, 'p', digits)} END"
    )


def address_parts_sql(text: str) -> str:
    """``struct<family, hi, lo>`` or null where the text is not an address."""
    half = "cast(conv(substring(d, {first}, 16), 16, -10) AS BIGINT)"
    v6 = _let(
        _v6_digits_sql(text),
        "d",
        f"CASE WHEN d IS NOT NULL THEN named_struct('family', 'v6', 'hi', {half.format(first=1)}, 'lo', {half.format(first=17)}) END",
    )
    v4 = _let(
        v4_number_sql(text), "n", "CASE WHEN n IS NOT NULL THEN named_struct('family', 'v4', 'hi', 0L, 'lo', n) END"
    )
    return f"CASE WHEN contains({text}, ':') THEN {v6} ELSE {v4} END"


def address_text_sql(family: str, hi: str, lo: str) -> str:
    """Canonical text: dotted quad, or lower-case IPv6 with the longest zero run cut."""
    groups = ", ".join(
        f"lower(hex(shiftrightunsigned({half}, {s}) & 65535))" for half in (hi, lo) for s in (48, 32, 16, 0)
    )
    cases = ""
    # The longest run is tried first, its leftmost occurrence wins.
    for n in range(8, 1, -1):
        shape = "^((?:[0-9a-f]+:)*?)" + ":".join(["0"] * n) + "((?::[0-9a-f]+)*)$"
        cases += (
            f" WHEN rlike(j, '{shape}') THEN concat(regexp_replace(regexp_extract(j, '{shape}', 1), ':$', ''), '::', "
            f"regexp_replace(regexp_extract(j, '{shape}', 2), '^:', ''))"
        )
    short = _let(f"concat_ws(':', {groups})", "j", f"CASE{cases} ELSE j END")
    low = f"({lo} & 4294967295L)"
    # IPv4-mapped and IPv4-compatible addresses end in a dotted quad.
    return (
        f"CASE WHEN {family} = 'v4' THEN {v4_text_sql(lo)} "
        f"WHEN {family} = 'v6' AND {hi} = 0 AND shiftrightunsigned({lo}, 32) = 65535 THEN concat('::ffff:', {v4_text_sql(low)}) "
        f"WHEN {family} = 'v6' AND {hi} = 0 AND shiftrightunsigned({lo}, 32) = 0 AND {low} > 65535 THEN concat('::', {v4_text_sql(low)}) "
        f"WHEN {family} = 'v6' THEN {short} END"
    )


def masks(family: str, plen: int) -> tuple[int, int]:
    """Both halves of a netmask as signed 64-bit numbers."""
    if family == "v4":
        return 0, 2**32 - 2 ** (32 - plen)
    mask = (2**128 - 1) ^ (2 ** (128 - plen) - 1)
    halves = mask >> 64, mask & (2**64 - 1)
    return tuple(h - 2**64 if h >= 2**63 else h for h in halves)


def mask_hi_sql(family: str, plen: str) -> str:
    """Upper half of the netmask (the JVM ignores a shift by 64, hence the branches)."""
    return (
        f"CASE WHEN {family} = 'v4' OR {plen} <= 0 THEN 0L WHEN {plen} >= 64 THEN -1L "
        f"ELSE shiftleft(-1L, 64 - {plen}) END"
    )


def mask_lo_sql(family: str, plen: str) -> str:
    """Lower half of the netmask."""
    return (
        f"CASE WHEN {family} = 'v4' THEN 4294967296L - shiftleft(1L, 32 - {plen}) WHEN {plen} <= 64 THEN 0L "
        f"WHEN {plen} >= 128 THEN -1L ELSE shiftleft(-1L, 128 - {plen}) END"
    )


def normalise_addresses(t: DataFrame, col: str, out: str = "addr") -> DataFrame:
    """Add ``<out>_family/_hi/_lo/_text`` and ``<out>_ok`` for an address text column."""
    parts = t.withColumn(f"__{out}", F.expr(address_parts_sql(f"`{col}`"))).selectExpr(
        *[f"`{c}`" for c in t.columns if c not in (f"{out}_family", f"{out}_hi", f"{out}_lo", f"{out}_text", f"{out}_ok")],
        f"__{out}.family AS {out}_family",
        f"__{out}.hi AS {out}_hi",
        f"__{out}.lo AS {out}_lo",
        f"__{out} IS NOT NULL AS {out}_ok",
    )
    return parts.withColumn(f"{out}_text", F.expr(address_text_sql(f"{out}_family", f"{out}_hi", f"{out}_lo")))


def cidr_parts_sql(text: str) -> str:
    """``struct<error, net: struct<family, net_hi, net_lo, plen>>`` of a CIDR text."""
    length = f"substring({text}, instr({text}, '/') + 1)"
    plen = f"CASE WHEN rlike({length}, '^[0-9]+$') AND NOT contains({length}, '\n') THEN try_cast({length} AS INT) END"
    hi, lo = mask_hi_sql("a.family", "n"), mask_lo_sql("a.family", "n")
    error = (
        f"CASE WHEN instr({text}, '/') = 0 THEN 'missing_slash' WHEN a IS NULL THEN 'bad_address' "
        "WHEN n IS NULL THEN 'bad_length' WHEN n > CASE WHEN a.family = 'v4' THEN 32 ELSE 128 END THEN 'too_long' "
        f"WHEN (a.family = 'v6' AND (a.hi & ~({hi})) <> 0) OR (a.lo & ~({lo})) <> 0 THEN 'host_bits_set' END"
    )
    net = "named_struct('family', a.family, 'net_hi', a.hi, 'net_lo', a.lo, 'plen', n)"
    found = _let(
        error, "e", f"named_struct('error', e, 'net', CASE WHEN e IS NULL AND {text} IS NOT NULL THEN {net} END)"
    )
    address = address_parts_sql(f"substring({text}, 1, instr({text}, '/') - 1)")
    return _let(address, "a", _let(plen, "n", found))


def normalise_cidrs(t: DataFrame, col: str, out: str = "cidr") -> DataFrame:
    """Add ``<out>`` = ``struct<family, net_hi, net_lo, plen>`` (null if bad) and ``<out>_error``.

    One expression yields both, so a filter on the error that Spark pushes below this
    projection does not repeat the parsing for every use of a part.
    """
    parsed = t.withColumn("__cidr", F.expr(cidr_parts_sql(f"`{col}`")))
    keep = [f"`{c}`" for c in t.columns if c not in (out, f"{out}_error")]
    return parsed.selectExpr(*keep, f"__cidr.net AS `{out}`", f"__cidr.error AS `{out}_error`")


def nets_of(t: DataFrame, col: str) -> DataFrame:
    """Rows whose CIDR text is valid, with ``family, net_hi, net_lo, plen`` instead of it.

    The parts come out of a generator, so each text is parsed once: a filter on them would be pushed below the
    projection and parse it again.
    """
    found = f"filter(transform(array({cidr_parts_sql(f'`{col}`')}), p -> p.net), x -> x IS NOT NULL)"
    return t.selectExpr(*[f"`{c}`" for c in t.columns], f"inline({found})")


def client_prefix(t: DataFrame, v4_len: int = 24, v6_len: int = 56) -> DataFrame:
    """Add the truncated source prefix (``prefix_hi``, ``prefix_lo``, ``prefix``)."""
    (h4, l4), (h6, l6) = masks("v4", v4_len), masks("v6", v6_len)
    text = address_text_sql("client_family", "prefix_hi", "prefix_lo")
    return t.withColumns(
        {
            "prefix_hi": F.expr(f"client_hi & CASE WHEN client_family = 'v4' THEN {h4}L ELSE {h6}L END"),
            "prefix_lo": F.expr(f"client_lo & CASE WHEN client_family = 'v4' THEN {l4}L ELSE {l6}L END"),
        }
    ).withColumn(
        "prefix",
        F.expr(f"concat({text}, '/', CASE WHEN client_family = 'v4' THEN '{v4_len}' ELSE '{v6_len}' END)"),
    )
