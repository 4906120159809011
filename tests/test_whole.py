"""The queries over all spots and all sites leave nothing out."""

import pandas as pd

from lociq import catalog

SF = "/root/testdata/sf0.01"


def test_all_embeddings_are_spots(spark):
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet")
    at = {f"s{i}": (float(e[0]) + 4.0 * (i // 500), float(e[1])) for i, e in zip(vectors.vec_id, vectors.embedding, strict=True)}
    got = {(r["src"], r["dst"]) for r in catalog.QUERIES["knn_graph"](spark, SF).collect()}
    expected, within = set(), (0.06**0.5) ** 2
    for a, (x, y) in at.items():
        near = sorted((d, b) for b, (u, v) in at.items() if a != b and (d := (x - u) * (x - u) + (y - v) * (y - v)) <= within)
        expected |= {(a, b) for _, b in near[:12]}
    assert got == expected and len({a for a, _ in got}) > 400
    assert catalog.QUERIES["spot_counts"](spark, SF).filter("n_before > 0").count() == len(at)


def test_all_sites_are_targets(spark):
    items, orders = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    reads = items.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    reads["read_id"] = reads.l_orderkey * 10 + reads.l_linenumber
    sites, expected = set(reads.l_partkey), {}
    for key, n, length in zip(reads.read_id, reads.l_partkey, reads.l_quantity.astype(int), strict=True):
        if key % 37:
            first = next(p for p in range(n, n + length + 2) if p in sites)
            expected[key] = min(first, expected.get(key, first))  # line items may share a number: one read
    got = {r["read_id"]: r["pos"] for r in catalog.QUERIES["range_detect"](spark, SF).collect()}
    assert got == expected and len(set(got.values())) > 1900
