"""Agreement of callers against plain sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lociq.operators import callers

NAMES = ["a", "b", "c"]


def table(spark, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([*NAMES, "other"]), rng.choice("uv"), f"s{rng.randrange(6)}", "1", rng.randrange(8), "A", "C") for _ in range(200)]
    spots = [(s, f"s{i}") for s in "uvw" for i in range(9)]  # some without variants, a section without any
    return rows, spots, spark.createDataFrame(rows, "caller string, section string, barcode string, chrom string, pos int, ref string, alt string"), spark.createDataFrame(spots, "section string, barcode string")


@pytest.mark.parametrize("quorum", [1, 2])
def test_equals_plain_sets(spark, quorum):
    rows, spots, calls, listed = table(spark)
    masks = callers.folded(calls, NAMES, ("section",))
    share = lambda x, y: x / y if y else 0.0
    each = {}
    for section, spot in spots:
        own = {c: {r[3:] for r in rows if r[:3] == (c, section, spot)} for c in NAMES}
        agreed = {v for v in set.union(*own.values()) if sum(v in own[c] for c in "bc") >= quorum}
        hit = len(agreed & own["a"])
        pairs = {f"{x}_{y}": share(len(own[x] & own[y]), len(own[x] | own[y])) for x, y in itertools.combinations(NAMES, 2)}
        each[section, spot] = (own, pairs, share(hit, len(agreed)), share(hit, len(own["a"])), share(2 * hit, len(agreed) + len(own["a"])))
    got = callers.per_spot(masks, listed, NAMES, "a", quorum, ("section",)).collect()
    assert len(got) == len(spots)
    for r in got:
        own, pairs, recall, precision, f1 = each[r["section"], r["barcode"]]
        assert [r[f"n_{c}"] for c in NAMES] == [len(own[c]) for c in NAMES] and r["n_all"] == len(own["a"] & own["b"] & own["c"])
        assert all(r[f"jaccard_{p}"] == pytest.approx(j) for p, j in pairs.items())
        assert (r["recall"], r["precision"], r["f1"]) == pytest.approx((recall, precision, f1))
    summary = {r["section"]: r for r in callers.section_summary(masks, listed, NAMES, "a", quorum, ("section",)).collect()}
    sizes = {(r["section"], r["callers"]): (r["n_exactly"], r["n_together"]) for r in callers.set_sizes(masks, NAMES, ("section",)).collect()}
    for section in "uvw":
        mine = [v for (s, _), v in each.items() if s == section]
        union = {c: set().union(*(own[c] for own, *_ in mine)) for c in NAMES}
        r = summary[section]
        assert r["n_spots"] == 9 and [r[f"union_{c}"] for c in NAMES] == [len(union[c]) for c in NAMES]
        assert r["f1_a_consensus_mean"] == pytest.approx(sum(v[4] for v in mine) / 9) and r["jaccard_b_c_mean"] == pytest.approx(sum(v[1]["b_c"] for v in mine) / 9)
        assert r["jaccard_union_a_b"] == pytest.approx(share(len(union["a"] & union["b"]), len(union["a"] | union["b"])))
        for n in range(1, 4):
            for some in itertools.combinations(NAMES, n):
                together = set.intersection(*(union[c] for c in some))
                exactly = together - set().union(*(union[c] for c in NAMES if c not in some))
                assert sizes.get((section, "+".join(some)), (0, 0)) == (len(exactly), len(together))
    assert len(callers.section_summary(masks, listed, NAMES, "a", by=("section",)).columns) == 21


def test_without_sections_and_odd_input(spark):
    _, _, calls, listed = table(spark)
    one = callers.section_summary(callers.folded(calls, ["a", "b"]), listed.select("barcode").distinct(), ["a", "b"], "b").collect()
    assert len(one) == 1 and one[0]["n_spots"] == 9
    empty = callers.section_summary(callers.folded(calls.limit(0), ["a"]), listed.select("barcode").distinct(), ["a"], "a").first()
    assert (empty["n_spots"], empty["union_a"], empty["f1_a_consensus_mean"]) == (9, 0, 0.0)
    null = callers.folded(calls.withColumn("caller", F.lit(None).cast("string")), ["a"])
    assert null.count() == 0
    for names in ([], ["a", "a"], [str(i) for i in range(11)]):
        with pytest.raises(ValueError, match="callers"):
            callers.folded(calls, names)
