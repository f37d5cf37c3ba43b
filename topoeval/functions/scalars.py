"""Column functions: deterministic hashing, vector arithmetic, bins, decisions, text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 2**31 - 1
Name = str | Column


def _col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- hashing ------------------------------------------------------------------------------


def stable_seed(*parts: Name, modulus: int = MODULUS) -> Column:
    """First 16 hex digits of sha256 of the parts joined by "|", as a number modulo ``modulus``."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    high = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % F.lit(modulus).cast("decimal(20,0)")).cast("long")


def stable_seed32(*parts: Name) -> Column:
    """First four bytes, little-endian, of sha256 of the parts joined by "::"."""
    digest = F.sha2(F.concat_ws("::", *[_col(p).cast("string") for p in parts]), 256)
    turned = F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)])
    return F.conv(turned, 16, 10).cast("long")


def stable_uniform(*parts: Name) -> Column:
    """A number in [0, 1) that only depends on the parts."""
    return stable_seed(*parts) / F.lit(float(MODULUS))


def config_id(family: Name, parameters: Name) -> Column:
    """family__ and ten hex digits of sha1 of the parameters' JSON text (keys in order)."""
    return F.concat(_col(family), F.lit("__"), F.substring(F.sha1(_col(parameters).cast("binary")), 1, 10))


def table_fingerprint(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row, fingerprint: sha256 over the digests of 256 ranges of rows' digests, each in order; the same for any order of rows.

    Digests are combined within 256 ranges of hash first, so no task holds the table's text.
    """
    row = F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *columns)]), 256)
    parts = df.select(row.alias("d")).groupBy(F.substring("d", 1, 2).alias("part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d")
    )
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "d"))), "\n"), 256).alias("fingerprint"))


# --- numbers ------------------------------------------------------------------------------


def number(c: Name) -> Column:
    """As double; what is none becomes NULL, and so do NaN and infinities."""
    x = _col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(x: Name, d: Name) -> Column:
    return _col(x) / F.greatest(_col(d), F.lit(1))


def safe_corr(x: Name, y: Name) -> Column:
    """Pearson correlation as an aggregate over pairs without NULL; NULL where a side does not vary."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    s = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(s > 1e-150, F.covar_pop(x, y) / s)


def clip(x: Name, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def minmax_scale(x: Name, keys: Sequence[str] = ()) -> Column:
    """(x - min) / (max - min) within the keys; 0 where that is undefined."""
    w = Window.partitionBy(*keys)
    low, high = F.min(_col(x)).over(w), F.max(_col(x)).over(w)
    return F.coalesce(F.when(high > low, (_col(x) - low) / (high - low)), F.lit(0.0))


def minmax_scaled(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """df with x_scaled for each x of the columns: (x - min) / (max - min) within the keys, 0 where that is undefined. Only the
    keys' extremes are joined to the rows; null keys are a key.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    ends = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(
        *[f(x).alias(f"__{side}{i}") for i, x in enumerate(columns) for side, f in (("low", F.min), ("high", F.max))]
    )
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    both = df.join(ends, same) if keys else df.crossJoin(F.broadcast(ends))
    for i, x in enumerate(columns):
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        both = both.withColumn(f"{x}_scaled", F.coalesce(F.when(high > low, (F.col(x) - low) / (high - low)), F.lit(0.0)))
    return both.drop(*names, *[f"__{side}{i}" for i in range(len(columns)) for side in ("low", "high")])


def softmax_weights(x: Name, keys: Sequence[str], temperature: float) -> Column:
    """exp(temperature * x), shifted by its maximum and clipped at 700, as shares within keys."""
    w = Window.partitionBy(*keys)
    z = _col(x) * temperature
    e = F.exp(clip(z - F.max(z).over(w), -700.0, 700.0))
    return e / F.sum(e).over(w)


def gumbel_key(x: Name, temperature: float, *seed: Name) -> Column:
    """The row with the largest key is a draw with the softmax weights of x."""
    u = F.greatest(stable_uniform(*seed), F.lit(1e-12))
    return _col(x) * temperature - F.log(-F.log(u))


# --- vectors ------------------------------------------------------------------------------


def dot(a: Name, b: Name) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2norm(a: Name) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Name, b: Name) -> Column:
    """0 where a vector is zero."""
    d = l2norm(a) * l2norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(0.0)


def sqdist(a: Name, b: Name) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)


def unit(a: Name) -> Column:
    n = l2norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: x.cast("double") / n)).otherwise(
        F.transform(_col(a), lambda x: x.cast("double"))
    )


# --- bins and decisions -------------------------------------------------------------------


def fixed_bin(x: Name, edges: Sequence[float]) -> Column:
    """0, 1, ... for right-closed bins (edges[k], edges[k + 1]]; NULL outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((_col(x) > edges[k]) & (_col(x) <= edges[k + 1]), k).otherwise(out)
    return out


def quantile_bin(df: DataFrame, x: str, bins: int, keys: Sequence[str] = (), name: str = "bin") -> DataFrame:
    """df with a right-closed quantile bin of x within the keys (duplicate edges are merged). The edges come from ranks over
    ranges, and are joined to the rows; null keys are a key.
    """
    from topoeval.functions.ranges import quantiles

    found = quantiles(df, x, [k / bins for k in range(bins + 1)], keys, "__cuts")
    names = [f"__q{i}" for i in range(len(keys))]
    cuts = found.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.array_distinct("__cuts").alias("__cuts"))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    joined = df.join(cuts, same, "left") if keys else df.join(F.broadcast(cuts), F.lit(True), "left")  # one row of edges
    below = F.size(F.filter("__cuts", lambda c: c < F.col(x)))
    return joined.withColumn(name, F.when(F.col(x).isNotNull(), F.greatest(below - 1, F.lit(0)))).drop("__cuts", *names)


def three_region(p: Name, recommend: float, avoid: float) -> Column:
    return F.when(_col(p) >= recommend, "Recommend").when(_col(p) <= avoid, "Avoid").otherwise("Uncertain")


def recommend_rule(baseline_f1: Name, lambda2: Name, diameter: Name, path: Name) -> Column:
    """Cascade of rules; a rule whose inputs are NULL does not hold."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    f1, l2, d, p = map(_col, (baseline_f1, lambda2, diameter, path))
    return (
        F.when(holds(f1 >= 0.88), "saturated_baseline")
        .when(holds(l2 < 0.001), "bottleneck")
        .when(holds(d > 50) | holds(p > 20), "long_range")
        .when(holds((l2 >= 0.03) & (p <= 4)), "well_connected")
        .when(holds(l2 >= 0.01), "moderate")
        .otherwise("undetermined")
    )


def candidate_label(name: Name, ratio: Name) -> Column:
    return F.when((_col(name) == "delaunay") & (_col(ratio) > 0), "vgae").otherwise(_col(name))


def success_flags(gain_pp: Name, thresholds: Sequence[float], prefix: str = "success") -> dict[str, Column]:
    """Columns prefix_t: gain strictly above t points."""
    return {f"{prefix}_{str(t).replace('.', '_')}": (_col(gain_pp) > t).cast("int") for t in thresholds}


# --- text ---------------------------------------------------------------------------------


def slug(c: Name) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[- ]", "_")


def ratio_label(ratio: Name) -> Column:
    return F.when(_col(ratio).isNull(), "original").otherwise(F.format_string("r%03d", F.round(_col(ratio) * 100).cast("int")))


def mode_fraction(c: Name) -> tuple[Column, Column]:
    """MODE:FRACTION split into both parts."""
    parts = F.split(_col(c), ":")
    return parts[0], parts[1].try_cast("double")


def format_metric(mean: Name, std: Name, ci95: Name) -> Column:
    """Percent text: mean, standard deviation and half width of the interval."""
    pc = [_col(x) * 100 for x in (mean, std, ci95)]
    return F.format_string("%.2f    %.2f (CI95:   %.2f)", *pc)


def json_fields(c: Name, /, **kinds: str) -> dict[str, Column]:
    """One column for each named field of a JSON text."""
    return {k: F.get_json_object(_col(c), f"$.{k}").try_cast(t) for k, t in kinds.items()}


def flatten_params(c: Name, /, **kinds: str) -> dict[str, Column]:
    return {f"param_{k}": x for k, x in json_fields(c, **kinds).items()}
