"""Client regions: longest-prefix match, client subnet override, candidates, ranking."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.netaddr import address_parts_sql, mask_hi_sql, mask_lo_sql, nets_of
from dnslens.session import shared_dir


#: Prefixes up to which the segments are made by the driver and broadcast. They have two segments for each prefix and
#: one for each of 2 x 65,536 buckets at most.
MAX_PREFIXES = 200_000

# Bits of an address that name its bucket: 16 for all prefixes of IPv4 and those of IPv6 up to /48, 48 for the longer ones.
_TOP = "CASE WHEN {family} = 'v4' THEN shiftrightunsigned({lo}, 16) ELSE shiftrightunsigned({hi}, CASE WHEN depth = 16 THEN 48 ELSE 16 END) END"
# Where an address is in its bucket; the sign bit is turned so that halves compare as unsigned numbers.
_PLACE = (
    "CASE WHEN {family} = 'v4' THEN named_struct('a', {lo} & 65535L, 'b', 0L) "
    "WHEN depth = 16 THEN named_struct('a', shiftrightunsigned({hi}, 16) & 4294967295L, 'b', 0L) "
    "ELSE named_struct('a', {hi} & 65535L, 'b', {lo} ^ shiftleft(1L, 63)) END"
)


def _of(template: str, depth: int | None = None, **names: str) -> str:
    text = template.format(**names)
    return text if depth is None else text.replace("depth", str(depth))


def _nets(cidrs: DataFrame) -> DataFrame:
    return nets_of(cidrs.select("region", "cidr"), "cidr").groupBy("family", "plen", "net_hi", "net_lo").agg(F.min("region").alias("found"))


def _sweep(nets: list[tuple[int, int, str]], width: int) -> dict[int, str | None]:
    """Where the region changes along the addresses, from (start, length, region) of nested prefixes."""
    changes: dict[int, str | None] = {}
    inside: list[tuple[int, str]] = []

    def leave(start: int) -> None:
        while inside and inside[-1][0] <= start:
            end = inside.pop()[0]
            changes[end] = inside[-1][1] if inside else None

    for start, plen, region in sorted(nets):
        leave(start)
        changes[start] = region
        inside.append((start + (1 << (width - plen)), region))
    leave(1 << width)
    changes.pop(1 << width, None)
    return changes


def _few_segments(cidrs: DataFrame) -> list[tuple]:
    """``flat_segments`` of a table of at most ``MAX_PREFIXES`` rows."""
    return _swept(nets_of(cidrs.select("region", "cidr"), "cidr"))


def _swept(nets: DataFrame) -> list[tuple]:
    half = 1 << 64
    known = nets.select("family", "plen", "net_hi", "net_lo", "region").collect()
    least: dict[tuple[str, int, int], str] = {}
    for r in known:
        key = r.family, r.net_lo if r.family == "v4" else (r.net_hi % half) * half + r.net_lo % half, r.plen
        least[key] = min(least.get(key, r.region), r.region)
    rows = []
    for family, depth, width, top in (("v4", 16, 32, 16), ("v6", 16, 128, 16), ("v6", 48, 128, 48)):
        nets = [(start, plen, region) for (f, start, plen), region in least.items() if f == family and (depth == 48 or family == "v4" or plen <= 48)]
        changes = _sweep(nets, width)
        points, rest = sorted(changes), width - top
        touched = {
            b for start, plen, _ in nets if depth == 16 or plen > 48
            for b in range(start >> rest, (start + (1 << (width - plen)) - 1 >> rest) + 1)
        }
        for b in sorted(touched):
            low = bisect_right(points, b << rest)
            starts = [b << rest, *points[low : bisect_left(points, b + 1 << rest)]]
            regions = [changes[points[low - 1]] if low else None, *(changes[x] for x in starts[1:])]
            if family == "v4":
                places = [(x & 0xFFFF, 0) for x in starts]
            elif depth == 16:
                places = [(x >> 80 & 0xFFFFFFFF, 0) for x in starts]
            else:
                places = [(x >> 64 & 0xFFFF, (x % half) - (half >> 1)) for x in starts]
            rows.append((family, depth, b, places, regions))
    return rows


def flat_segments(cidrs: DataFrame) -> DataFrame:
    """Nested prefixes as disjoint segments: family, depth, top, places, regions.

    A row is a bucket of addresses that agree in their first bits; ``places`` are the starts of its segments in order,
    ``regions`` the region of the longest prefix around each (null where there is none). Only starts of prefixes, the
    addresses behind their ends, and starts of buckets can begin a segment, so just these are looked up by length.
    """
    return _flat(_nets(cidrs))


def _flat(nets: DataFrame) -> DataFrame:
    ends = nets.selectExpr(
        "family", "plen", "net_hi AS hi", "net_lo AS lo",
        f"CASE WHEN family = 'v4' THEN 0L ELSE net_hi | ~({mask_hi_sql('family', 'plen')}) END AS last_hi",
        f"CASE WHEN family = 'v4' THEN net_lo + shiftleft(1L, 32 - plen) - 1 ELSE net_lo | ~({mask_lo_sql('family', 'plen')}) END AS last_lo",
        "CASE WHEN family = 'v6' AND plen > 48 THEN 48 ELSE 16 END AS depth",
    )
    buckets = (
        f"transform(sequence({_of(_TOP, family='family', hi='hi', lo='lo')}, {_of(_TOP, family='family', hi='last_hi', lo='last_lo')}), "
        "x -> named_struct('hi', CASE WHEN family = 'v4' THEN 0L ELSE shiftleft(x, CASE WHEN depth = 16 THEN 48 ELSE 16 END) END, "
        "'lo', CASE WHEN family = 'v4' THEN shiftleft(x, 16) ELSE 0L END))"
    )

    def after(half: str) -> str:
        return f"CASE WHEN {half} = 9223372036854775807L THEN shiftleft(1L, 63) ELSE {half} + 1 END"

    behind = (
        "CASE WHEN family = 'v4' THEN filter(array(named_struct('hi', 0L, 'lo', last_lo + 1)), x -> x.lo < 4294967296L) "
        f"WHEN last_lo <> -1L THEN array(named_struct('hi', last_hi, 'lo', {after('last_lo')})) "
        f"ELSE filter(array(named_struct('hi', {after('last_hi')}, 'lo', 0L)), x -> x.hi <> 0L) END"
    )
    points = ends.select(
        "family", "depth", F.explode(F.expr(f"concat(array(named_struct('hi', hi, 'lo', lo)), {buckets}, {behind})")).alias("p")
    ).select("family", "depth", "p.hi", "p.lo").distinct()
    # Two families have 33 + 129 lengths at most.
    lengths = F.broadcast(nets.select("family", "plen").distinct())
    masked = points.join(lengths, "family").filter("depth = 48 OR plen <= 48").selectExpr(
        "family", "depth", "hi", "lo", "plen",
        f"hi & {mask_hi_sql('family', 'plen')} AS net_hi", f"lo & {mask_lo_sql('family', 'plen')} AS net_lo",
    )
    won = masked.join(nets, ["family", "plen", "net_hi", "net_lo"], "left").groupBy("family", "depth", "hi", "lo").agg(
        F.max_by("found", F.when(F.col("found").isNotNull(), F.col("plen"))).alias("region")
    )
    names = dict(family="family", hi="hi", lo="lo")
    starts = won.selectExpr(
        "family", "depth", f"{_of(_TOP, **names)} AS top",
        f"named_struct('place', {_of(_PLACE, **names)}, 'region', region) AS segment",
    )
    rows = starts.groupBy("family", "depth", "top").agg(F.sort_array(F.collect_list("segment")).alias("s"))
    return rows.selectExpr("family", "depth", "top", "s.place AS places", "s.region AS regions")


def region_lpm(
    q: DataFrame,
    cidrs: DataFrame,
    out: str = "region",
    family: str = "client_family",
    hi: str = "client_hi",
    lo: str = "client_lo",
) -> DataFrame:
    """Add the region of the longest configured prefix containing the address.

    An address is looked up in the segments of its bucket (``flat_segments``) by bisection. The distinct prefixes are
    counted, and stored where the table has more rows: up to ``MAX_PREFIXES`` the buckets are broadcast and the rows of ``q`` stay where they are, beyond it Spark makes
    them and joins on the bucket as it sees fit. A prefix listed twice has its least region; an existing column ``out`` is replaced, and
    the new one comes last.
    """
    few, swept = cidrs.limit(MAX_PREFIXES + 1).count() <= MAX_PREFIXES, None
    if few:
        swept = _few_segments(cidrs)
    else:
        shared_dir(q.sparkSession)
        nets = _nets(cidrs).checkpoint()
        few = nets.count() <= MAX_PREFIXES
        swept = _swept(nets.withColumnRenamed("found", "region")) if few else None
    if few:
        kind = "family string, depth int, top long, places array<struct<a: long, b: long>>, regions array<string>"
        buckets = q.sparkSession.createDataFrame(swept, kind)
    else:
        buckets = _flat(nets)
    kept = [f"`{c}`" for c in q.columns if c != out]
    names = dict(family=f"`{family}`", hi=f"`{hi}`", lo=f"`{lo}`")
    for depth in (16, 48):
        mine = buckets.filter(f"depth = {depth}").selectExpr(
            f"family AS __f{depth}", f"top AS __t{depth}", f"places AS __p{depth}", f"regions AS __r{depth}"
        )
        same = F.expr(f"`{family}` = __f{depth} AND {_of(_TOP, depth, **names)} = __t{depth}")
        q = q.join(F.broadcast(mine) if few else mine, same, "left")

    def region(depth: int) -> str:
        """The last segment that starts at the address or before it."""
        p, r, x = f"__p{depth}", f"__r{depth}", _of(_PLACE, depth, **names)
        step = f"CASE WHEN {p}[(s.l + s.h + 1) div 2] <= x THEN named_struct('l', cast((s.l + s.h + 1) div 2 AS INT), 'h', s.h) " \
               "ELSE named_struct('l', s.l, 'h', cast((s.l + s.h + 1) div 2 - 1 AS INT)) END"
        halves = f"aggregate(sequence(1, length(bin(size({p})))), named_struct('l', 0, 'h', size({p}) - 1), (s, i) -> " \
                 f"CASE WHEN s.l < s.h THEN {step} ELSE s END, s -> s.l)"
        return f"{r}[CASE WHEN size({p}) = 1 THEN 0 ELSE transform(array({x}), x -> {halves})[0] END]"

    return q.selectExpr(*kept, f"CASE WHEN __t48 IS NOT NULL THEN {region(48)} WHEN __t16 IS NOT NULL THEN {region(16)} END AS `{out}`")


def region_ecs(q: DataFrame, cidrs: DataFrame, trust: bool = False, plen: int = 24, out: str = "region") -> DataFrame:
    """Region of the client subnet option where trusted, else of the source address.

    Only the first ``plen`` bits (or the option's own shorter length) are used.
    """
    if not trust:
        return region_lpm(q, cidrs, out)
    bits = f"least(edns.ecs_plen, {plen})"
    df = q.withColumn("__e", F.expr(f"CASE WHEN edns.present THEN {address_parts_sql('edns.ecs_ip')} END")).selectExpr(
        *[f"`{c}`" for c in q.columns],
        "coalesce(__e.family, client_family) AS __ef",
        f"coalesce(__e.hi & {mask_hi_sql('__e.family', bits)}, client_hi) AS __eh",
        f"coalesce(__e.lo & {mask_lo_sql('__e.family', bits)}, client_lo) AS __el",
    )
    return region_lpm(df, cidrs, out, "__ef", "__eh", "__el").drop("__ef", "__eh", "__el")


def candidates(regions: DataFrame, backends: DataFrame, affinity: DataFrame) -> DataFrame:
    """Every region paired with every backend of its deployment, with tier and distance.

    Both sides carry ``config_id``: the pairs are an equi-join inside each deployment, and
    unlisted affinities come last.
    """
    return (
        regions.join(backends, "config_id")
        .join(affinity, ["region", "site"], "left")
        .withColumn("tier", F.coalesce("tier", F.lit(2147483647)))
        .withColumn("geo_distance", F.coalesce("geo_distance", F.lit(float("inf"))))
    )


def geo_rank(c: DataFrame, mode: str = "geo_first", keys: tuple[str, ...] = ("version", "region")) -> DataFrame:
    """Best backend per group: by (tier, latency) or by (latency, tier), then by name."""
    if mode == "geo_first":
        order = ["tier", "ewma_us", "backend"]
    elif mode == "latency_first":
        order = ["ewma_us", "tier", "backend"]
    else:
        raise ValueError(f"unknown geo mode {mode!r}")
    best = F.min_by(F.struct(*[F.col(x) for x in c.columns if x not in keys]), F.struct(*order))
    return c.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def top_k(t: DataFrame, col: str, k: int, keys: tuple[str, ...] = ("bin",)) -> DataFrame:
    """The k most frequent values per group with their share; ties go to the smaller value."""
    counts = t.groupBy(*keys, col).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), col))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(total, list(keys)).withColumn("share", F.col("n") / F.col("total"))


def latest(t: DataFrame, keys: tuple[str, ...] = ("region", "backend"), version: str = "version") -> DataFrame:
    """The newest snapshot row per key, by partial aggregation."""
    rest = [c for c in t.columns if c not in keys]
    return (
        t.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(version)).alias("b"))
        .select(*keys, "b.*")
    )


