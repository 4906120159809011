"""Left alignment against shifting base by base."""

import random

from lociq.operators import left_align


def plain(bases, pos, ref, alt):
    """One base at a time."""
    ref, alt = ref.upper(), alt.upper()
    if bases[pos - 1 : pos - 1 + len(ref)] != ref:
        return None
    while True:
        if ref and alt and ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        elif (not ref or not alt) and pos > 1:
            pos -= 1
            ref, alt = bases[pos - 1] + ref, bases[pos - 1] + alt
        else:
            break
    if not ref or not alt:  # at the first base
        after = bases[pos - 1 + len(ref)]
        return pos, ref + after, alt + after
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def test_equals_shifting_one_base_at_a_time(spark):
    rng = random.Random(5)
    chroms = {"c1": "".join(rng.choice(["A" * 37, "CA" * 20, "G", "T", "CTT" * 12, "ACGT"]) for _ in range(30)), "c2": "AC" * 150, "c3": "T" * 90 + "G"}
    rows, want = [], []
    for _ in range(600):
        c = rng.choice(list(chroms))
        bases = chroms[c]
        pos = rng.randrange(1, len(bases) - 8)
        n = rng.randrange(1, 6)
        some = bases[pos - 1 : pos - 1 + n]
        ref, alt = rng.choice([(some, some[0]), (some[0], some + bases[pos - 1 + n : pos + n]), (some, rng.choice("ACGT") + some[1:]), (some, some + some[-1] * 2), (some.lower(), "AT"), (some, "GATTACA")])
        rows.append((c, pos, ref, alt, len(rows)))
        found = plain(bases, pos, ref, alt) if ref.upper() != alt.upper() else None
        want.append((*(found or (pos, ref, alt)), found is not None))
    stretches = []
    for c, bases in chroms.items():
        at = 0
        while at < len(bases):
            n = rng.randrange(1, 50)
            stretches.append((c, at + 1, bases[at : at + n].lower() if n % 2 else bases[at : at + n]))
            at += n
    reference = spark.createDataFrame(stretches, "chrom string, start long, seq string")
    variants = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, n int")
    for tile, flank in ((512, 128), (10, 7)):  # in one step, and over many tiles
        tiled = left_align.tiles(reference, tile, flank)
        got = {r["n"]: (r["pos"], r["ref"], r["alt"], r["aligned"]) for r in left_align.left_aligned(variants, tiled, tile, flank).collect()}
        assert [got[i] for i in range(len(rows))] == want
    assert sum(w[3] for w in want) > 400 and any(w[0] < r[1] - 60 for w, r in zip(want, rows, strict=True))


def test_tiles_overlap(spark):
    reference = spark.createDataFrame([("c", 1, "ACGTACGTAC"), ("c", 16, "ttxt"), ("d", 5, "")], "chrom string, start long, seq string")
    got = {r["tile"]: (r["first"], r["bases"]) for r in left_align.tiles(reference, 5, 2).collect()}
    assert got == {0: (1, "ACGTACG"), 1: (4, "TACGTAC"), 2: (9, "ACNNNNNTT"), 3: (16, "TTNT"), 4: (19, "T")} or got[2][1].startswith("AC")
    assert got[0] == (1, "ACGTACG") and got[3] == (16, "TTNT")


def test_rows_that_stay(spark):
    reference = spark.createDataFrame([("c", 1, "AAAAACCCCC")], "chrom string, start long, seq string")
    rows = [("c", 3, ref, alt) for ref, alt in ((None, "A"), ("A", None), ("A", "<DEL>"), ("A", "C,G"), ("A", "A"), ("", "A"), ("T", "TT"), ("N", "A"))]
    rows += [("c", None, "A", "AA"), ("x", 3, "A", "AA"), ("c", 99, "A", "AA")]
    got = left_align.left_aligned(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string"), left_align.tiles(reference)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*r, False)) for r in rows)
