"""How several callers agree, spot by spot and over a whole section."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.operators.panel import KEY

MOST_CALLERS = 10  # a section has 2 ** callers sets


def folded(calls: DataFrame, names: list[str], by: tuple[str, ...] = (), variant: tuple[str, ...] = KEY) -> DataFrame:
    """One row for each variant of a spot (``by``, barcode and ``variant``) with ``mask``: bit i is set if caller ``names[i]`` has it.

    ``calls`` (caller, barcode, the variant's columns) may repeat rows; other callers' rows are left out. One aggregation with
    partial results on the map side, so a variant that all spots share, or a spot with very many, is combined before it is sent.
    """
    if not 0 < len(names) <= MOST_CALLERS or len(set(names)) < len(names):
        raise ValueError(f"1 to {MOST_CALLERS} different callers")
    bit = F.lit(None).cast("int")
    for i, name in enumerate(names):
        bit = F.when(F.col("caller") == name, 1 << i).otherwise(bit)
    rows = calls.select(*by, "barcode", *variant, bit.alias("bit")).filter("bit IS NOT NULL")
    return rows.groupBy(*by, "barcode", *variant).agg(F.bit_or("bit").alias("mask"))


def _has(mask: Column, bits: int) -> Column:
    """Whether all callers of ``bits`` have it."""
    return mask.bitwiseAND(bits) == bits


def _agreed(mask: Column, target: int, quorum: int) -> Column:
    """Whether at least ``quorum`` callers other than the target have it."""
    return F.bit_count(mask.bitwiseAND(~(1 << target))) >= quorum


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _pairs(names: list[str]) -> list[tuple[str, int, int]]:
    return [(f"{names[a]}_{names[b]}", a, b) for a, b in combinations(range(len(names)), 2)]


def _sets(names: list[str], target: int, quorum: int) -> dict[str, Column]:
    """Counts of a group of masks: of every caller, of every pair, of all, of what the others agree on, and of what of that the target has."""
    mask = F.col("mask")
    out = {f"n_{name}": F.count_if(_has(mask, 1 << i)) for i, name in enumerate(names)}
    out |= {f"both_{pair}": F.count_if(_has(mask, (1 << a) | (1 << b))) for pair, a, b in _pairs(names)}
    agreed = _agreed(mask, target, quorum)
    return out | {"n_all": F.count_if(_has(mask, (1 << len(names)) - 1)), "n_consensus": F.count_if(agreed), "n_hit": F.count_if(agreed & _has(mask, 1 << target))}


def per_spot(masks: DataFrame, spots: DataFrame, names: list[str], target: str, quorum: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """For each of ``spots`` (``by`` and barcode; one row each, those without any variant too): the sizes of all callers' sets, of pairs
    and of what all share; the Jaccard index of each pair; and recall, precision and F1 of ``target`` against the consensus, the
    variants that at least ``quorum`` other callers have.

    A share of nothing is 0. Variants of spots that are not listed are left out.
    """
    which = names.index(target)
    counted = masks.groupBy(*by, "barcode").agg(*[c.alias(n) for n, c in _sets(names, which, quorum).items()])
    sizes = [c for c in counted.columns if c not in (*by, "barcode")]
    rows = spots.select(*by, "barcode").join(counted, [*by, "barcode"], "left").na.fill(0, sizes)
    n = lambda c: F.col(f"n_{c}")
    scores = {f"jaccard_{pair}": _share(F.col(f"both_{pair}"), n(names[a]) + n(names[b]) - F.col(f"both_{pair}")) for pair, a, b in _pairs(names)}
    scores |= {"recall": _share(n("hit"), n("consensus")), "precision": _share(n("hit"), n(target)), "f1": _share(2 * n("hit"), n("consensus") + n(target))}
    return rows.withColumns(scores)


def set_sizes(masks: DataFrame, names: list[str], by: tuple[str, ...] = (), variant: tuple[str, ...] = KEY) -> DataFrame:
    """For each set of callers (``callers``, their names joined by ``+``) the distinct variants of the section that exactly these have
    in any spot (n_exactly), and that at least these have (n_together). Sets without variants are left out."""
    union = masks.groupBy(*by, *variant).agg(F.bit_or("mask").alias("mask"))
    exact = union.groupBy(*by, "mask").agg(F.count("*").alias("n"))
    # At most 2 ** callers rows for a section from here on.
    subsets = F.filter(F.sequence(F.lit(1), F.lit((1 << len(names)) - 1)), lambda s: s.bitwiseAND(F.col("mask")) == s)
    spread = exact.withColumn("s", F.explode(subsets)).groupBy(*by, "s").agg(F.coalesce(F.sum(F.when(F.col("s") == F.col("mask"), F.col("n"))), F.lit(0)).alias("n_exactly"), F.sum("n").alias("n_together"))
    named = F.concat_ws("+", *[F.when(_has(F.col("s"), 1 << i), F.lit(name)) for i, name in enumerate(names)])
    return spread.select(*by, named.alias("callers"), "n_exactly", "n_together")


def section_summary(masks: DataFrame, spots: DataFrame, names: list[str], target: str, quorum: int = 1, by: tuple[str, ...] = (), variant: tuple[str, ...] = KEY) -> DataFrame:
    """One row for each section: spots, spots with any variant of each caller, distinct variants of each caller, shared by all and
    by each pair, the pairs' Jaccard indices over these, the means over spots of the pairs' Jaccard indices, and the means of recall,
    precision and F1 of the target.

    Means are over all ``spots``; a section without a listed spot has no row, one without variants has zeros.
    """
    each = per_spot(masks, spots, names, target, quorum, by)
    pairs = _pairs(names)
    means = {f"jaccard_{p}_mean": f"jaccard_{p}" for p, *_ in pairs} | {f"{s}_{target}_consensus_mean": s for s in ("recall", "precision", "f1")}
    over_spots = each.groupBy(*by).agg(F.count("*").alias("n_spots"), *[F.count_if(F.col(f"n_{c}") > 0).alias(f"n_spots_with_{c}") for c in names], *[F.avg(c).alias(m) for m, c in means.items()])
    listed = masks.join(spots.select(*by, "barcode"), [*by, "barcode"], "left_semi")
    union = listed.groupBy(*by, *variant).agg(F.bit_or("mask").alias("mask"))
    mask = F.col("mask")
    sizes = {f"union_{c}": _has(mask, 1 << i) for i, c in enumerate(names)} | {"union_all": _has(mask, (1 << len(names)) - 1)} | {f"both_{p}": _has(mask, (1 << a) | (1 << b)) for p, a, b in pairs}
    whole = union.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in sizes.items()])
    rows = over_spots.join(whole, list(by), "left") if by else over_spots.join(F.broadcast(whole))  # one row each
    rows = rows.na.fill(0, list(sizes))
    jaccard = {f"jaccard_union_{p}": _share(F.col(f"both_{p}"), F.col(f"union_{names[a]}") + F.col(f"union_{names[b]}") - F.col(f"both_{p}")) for p, a, b in pairs}
    return rows.withColumns(jaccard).select(*by, "n_spots", *[f"n_spots_with_{c}" for c in names], *sizes, *jaccard, *means)
