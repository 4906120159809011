"""Hand-made rows for the semantics of each operator, and brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

from lociq.components import components
from lociq.functions import fields
from lociq.operators import genotype, learning, matrix, ordering, panel, reads, reports, spatial, transitions
from lociq.plans import pipelines
from lociq.sources import config, readers, sinks
from lociq.streaming import counts as streaming

GOLDEN = [
    ("plain het", "12", "3,3,3,3", "40,0,40", "0/1", 40, 0.5, "PASS"),
    ("plain hom", "7", "0,0,4,3", "90,21,0", "1/1", 21, 1.0, "PASS"),
    ("hom-ref", "9", "9,0,0,0", "0,10,90", None, None, None, None),
    ("tie first wins", "9", "5,0,4,0", "5,5,9", None, None, None, None),
    ("tie het hom", "10", "5,4,1,0", "9,3,3", "0/1", 0, 0.1, "LowGQ;DiscordantBAF"),
    ("two values", "3", "1,1,1,0", "1,2", None, None, None, None),
    ("no values", "3", "1,1,1,0", ".", None, None, None, None),
    ("no counts", "8", None, "40,0,40", "0/1", 40, 0.0, "DiscordantBAF"),
    ("bad counts", "8", "1,x,1,0", "40,0,40", "0/1", 40, 0.0, "DiscordantBAF"),
    ("lower edge", "20", "13,0,7,0", "40,0,40", "0/1", 40, 0.35, "PASS"),
    ("upper edge", "20", "7,0,13,0", "40,0,40", "0/1", 40, 0.65, "PASS"),
    ("hom edge", "20", "3,0,17,0", "90,30,0", "1/1", 30, 0.85, "PASS"),
    ("quality edge", "12", "3,3,3,3", "8,0,40", "0/1", 8, 0.5, "PASS"),
    ("rounding", "16", "15,0,1,0", "40,0,40", "0/1", 40, 0.0625, "DiscordantBAF"),
    ("bad depth", ".", "3,3,3,3", "40,0,40", None, None, None, None),
]


def records(spark, cases):
    rows = [("1", i, ".", "A", "C", ".", ".", f"DP={c[1]}" + (f";I16={c[2]},0,0,0,0,0,0,0,0,0,0,0,0" if c[2] else ""), "PL", c[3]) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, readers.variant_schema())


def test_golden_genotypes(spark):
    got = {r["pos"]: r for r in genotype.called(records(spark, GOLDEN), 0, 8, 0.0).collect()}
    for i, (name, *_, gt, gq, baf, flags) in enumerate(GOLDEN):
        if gt is None:
            assert i not in got, name
        else:
            assert (got[i]["gt"], got[i]["gq"], got[i]["baf"], got[i]["filter"]) == (gt, gq, pytest.approx(baf), flags), name
    bad = {r["pos"]: r["reason"] for r in genotype.rejected(records(spark, GOLDEN)).collect()}
    assert bad == {5: "likelihoods", 6: "likelihoods", 14: "depth"}


def test_sample_text_rounds_half_to_even(spark):
    rows = genotype.annotated_sample(genotype.called(records(spark, GOLDEN[13:14]), 0, 8, 0.0)).first()
    assert (rows["format"], rows["sample"]) == ("GT:GQ:BAF:PL", "0/1:40:0.062:40,0,40")


def test_info_values(spark):
    row = spark.range(1).select(
        fields.info_value(F.lit("A=1;DP=7=8;DP=9;XDP=3"), "DP").alias("dp"), fields.info_value(F.lit("XDP=3;FLAG"), "DP").alias("none"),
        fields.format_value(F.lit("GT:PL"), F.lit("0/1:1,2,3"), "PL").alias("pl"), fields.format_value(F.lit("GT"), F.lit("0/1"), "GQ").alias("gq"), fields.prefixed_chrom(F.lit("X")).alias("x"), fields.prefixed_chrom(F.lit("MT")).alias("mt"),
    ).first()
    assert tuple(row) == ("7", None, "1,2,3", None, "chrX", "MT")


def test_panel_is_exact_on_four_columns_and_pool_prefers_the_first_source(spark):
    a = spark.createDataFrame([("chr1", 100, "A", "C"), ("chr1", 100, "A", "G")], "chrom string, pos int, ref string, alt string")
    b = a.filter("alt = 'C'")
    assert panel.defined(a, b).count() == 1 and panel.denovo(a, b).first()["alt"] == "G"
    bare = a.withColumn("chrom", F.lit("1"))
    assert {(r["alt"], r["race"]) for r in panel.pool([("defined", b), ("denovo", bare)]).collect()} == {("C", "defined"), ("G", "denovo")}
    gts = spark.createDataFrame([("0/1",), ("0|1",), ("1/1",), ("./.",), ("1|0",)], "gt string")
    assert panel.valid_genotypes(gts).count() == 2 and panel.valid_genotypes(gts, phased_too=True).count() == 4


def test_last_phased_row_of_a_position_counts(spark):
    rows = [("1", 100, "A", "C", "0/1", 0.5, 9), ("1", 100, "A", "G", "0/1", 0.5, 9), ("1", 200, "A", "C", "0/1", None, 9)]
    original = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, gt string, baf double, dp int")
    phased = original.withColumns({"gt": F.lit("0/0"), "ord": F.col("alt"), "baf": F.lit(0.1)})
    assert [r["alt"] for r in transitions.transitions(original, phased).collect()] == ["G"]


def test_thresholds_are_exact_medians_and_errors_inclusive(spark):
    changes = spark.createDataFrame([("A", "C", "0/1", "0/0", b, d) for b, d in ((0.1, 4), (0.2, 4), (0.4, 9), (0.5, 9))], "ref string, alt string, orig_gt string, new_gt string, baf double, depth int")
    learned = transitions.thresholds(changes)
    assert (learned.first()["baf_thr"], learned.first()["depth_thr"]) == (pytest.approx(0.3), 6.5)
    calls = spark.createDataFrame([("A", "C", "0/1", 0.25, 6), ("A", "C", "0/1", 0.25, 7), ("A", "C", "0/0", 0.1, 1), ("A", "C", "0/1", None, 1), ("A", "C", "0|1", 0.1, 1), ("A", "G", "0/1", 0.1, 1), ("A", "C", "0/1", 0.30000000000000004, 6)], "ref string, alt string, gt string, baf double, dp int")
    judged = transitions.error_status(calls, learned.withColumn("baf_thr", F.lit(0.30000000000000004)))
    assert sorted(r["status"] for r in judged.collect()) == ["error", "error", "hom_ref", "missing", "no_error", "no_error", "no_error"]
    assert transitions.error_summary(judged).first()["error_pct"] == pytest.approx(100 * 2 / 6)


def test_read_is_credited_with_its_lowest_position_only(spark):
    positions = spark.createDataFrame([("1", p, "A", "C", "o") for p in (99, 100, 120, 151, 152)], "chrom string, pos int, ref string, alt string, ord string")
    cases = [(1, 99, 150, False, 100), (2, 100, 150, False, 120), (3, 120, 150, False, 151), (4, 150, 200, False, 151), (5, 151, None, False, 152), (6, 99, 150, True, None), (7, 300, 400, False, None)]
    table = spark.createDataFrame([(i, "b", "chr1", s, e, u) for i, s, e, u, _ in cases], "read_id long, barcode string, chrom string, start0 int, end0 int, unmapped boolean")
    got = {r["read_id"]: r["pos"] for r in reads.first_overlaps(table, positions, bin_size=16).collect()}
    assert got == {i: p for i, *_, p in cases if p}


def test_range_join_equals_two_pointers(spark):
    rng = random.Random(3)
    positions = sorted(rng.sample(range(5000), 200))
    intervals = [(i, s := rng.randrange(5000), s + rng.randrange(1, 400)) for i in range(800)]
    table = spark.createDataFrame([(i, "b", "1", s, e, False) for i, s, e in intervals], "read_id long, barcode string, chrom string, start0 int, end0 int, unmapped boolean")
    found = reads.first_overlaps(table, spark.createDataFrame([("1", p) for p in positions], "chrom string, pos int"))
    expected = {i: min(p for p in positions if s + 1 <= p <= e + 1) for i, s, e in intervals if any(s + 1 <= p <= e + 1 for p in positions)}
    assert {r["read_id"]: r["pos"] for r in found.collect()} == expected


def test_frequency_counts_barcodes_with_any_variant(spark):
    found = spark.createDataFrame([("a", "1", 5, "A", "C"), ("b", "1", 5, "A", "C"), ("b", "1", 6, "A", "C")], "barcode string, chrom string, pos int, ref string, alt string")
    assert {r["pos"]: r["freq"] for r in reads.barcode_frequency(found).collect()} == {5: 1.0, 6: 0.5}


def brute_graph(points, within, most=12):
    edges = set()
    for a, (x, y) in points.items():
        near = sorted(((x - u) ** 2 + (y - v) ** 2, b) for b, (u, v) in points.items() if b != a)
        edges |= {(a, b) for d, b in [n for n in near if n[0] <= within * within][:most]}
    return edges


def spots_of(spark, points):
    return spark.createDataFrame([(b, 1, float(x), float(y)) for b, (x, y) in points.items()], "barcode string, in_tissue int, x double, y double")


def test_graph_equals_brute_force(spark):
    rng = random.Random(1)
    points = {f"s{i:03}": (rng.randrange(40), rng.randrange(40)) for i in range(300)}
    got = {(r["src"], r["dst"]) for r in spatial.graph(spots_of(spark, points), 6.0).collect()}
    assert got == brute_graph(points, 6.0) and spatial.radius(None) == 900 and spatial.radius(100) == 900
    assert spatial.graph(spots_of(spark, {"a": (0, 0), "b": (900, 0)}), 900.0).count() == 2


def test_neighbour_support(spark):
    spots = spots_of(spark, {"A": (0, 0), "B": (1, 0), "C": (0, 1), "D": (90, 90)})
    edges = spatial.graph(spots, 5.0)
    snvs = spark.createDataFrame([(b, "1", 7) for b in "ABCD"] + [("A", "1", 8), ("B", "1", 8)], "barcode string, chrom string, pos int")
    kept = lambda m, **k: {(r["barcode"], r["pos"]) for r in spatial.supported(snvs, edges, spots, m, **k).collect()}
    assert {b for b, p in kept(2) if p == 7} == set("ABC") and not {b for b, p in kept(2) if p == 8}
    assert kept(3) == set() and len(kept(0)) == 6 and {b for b, p in kept(1) if p == 8} == set("AB")
    pool = spark.createDataFrame([("1", 7)], "chrom string, pos int")
    assert {b for b, p in kept(9, kept=pool)} == set("ABCD")


def test_pools_and_counts(spark):
    pool = spark.createDataFrame([("chr1", 500, "A", "C,G"), ("1", 600, "A", "C")], "chrom string, pos int, ref string, alt string")
    assert spatial.pool_positions(pool).count() == 1 and spatial.pool_positions(pool, allow_multiallelic=True).count() == 2
    spots = spots_of(spark, {"A": (0, 0), "B": (1, 0)})
    empty = spark.createDataFrame([], "barcode string, chrom string, pos int")
    assert {tuple(r) for r in spatial.counts(spots, empty, empty).collect()} == {("A", 0, 0), ("B", 0, 0)}
    flagged = spots.withColumn("in_tissue", F.when(F.col("barcode") == "A", 0).otherwise(1))
    assert [r["barcode"] for r in spatial.in_tissue(flagged).collect()] == ["B"]
    assert spatial.excluded(empty, spatial.pool_positions(pool)).count() == 0


def test_multiallelic_likelihoods(spark):
    row = spark.createDataFrame([("1", 5, "A", "C,G", [0, 1, 2, 3, 4, 5])], "chrom string, pos int, ref string, alt string, pl array<int>")
    assert {(r["alt"], tuple(r["pl"])) for r in genotype.split_multiallelic(row).collect()} == {("C", (0, 1, 2)), ("G", (0, 3, 5))}


def test_features(spark):
    rows = [("1", 9, "QS=0.5,0.5;DP=7;VDB=0.3,9", "GT:BAF:GQ", "0/1:0.4:30"), ("1", 8, "DP=2;I16=" + ",".join(map(str, range(16))), "GT", "0/1")]
    got = {r["pos"]: r for r in learning.features(spark.createDataFrame(rows, "chrom string, pos int, info string, format string, sample string")).collect()}
    assert (got[9]["f_qs"], got[9]["f_dp"], got[9]["f_vdb"], got[9]["f_baf"], got[9]["f_gq"], got[9]["f_i16_0"]) == (0.0, 7.0, 0.3, 0.4, 30.0, None)
    assert (got[8]["f_i16_15"], got[8]["f_baf"]) == (15.0, 0.0)


def test_quotas():
    assert learning.quotas({"homozygous": 10, "heterozygous": 20, "no_variance": 70}, 50) == {"homozygous": 5, "heterozygous": 10, "no_variance": 35}
    assert learning.quotas({"homozygous": 1}, 50) == {"homozygous": 1}


def test_classes_keep_their_probabilities(spark):
    rng = random.Random(2)
    rows = [("1", i, "A", "C", c, float(k) + rng.random() / 4, rng.random()) for i in range(120) for k, c in [(i % 3, learning.CLASSES[i % 3])]]
    table = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, label string, f_dp double, f_baf double")
    for kind in ("forest", "perceptron"):
        out = learning.classified(learning.train(table, kind, ("f_dp", "f_baf")), table)
        named = F.when(F.col("predicted") == "heterozygous", F.col("p_het")).when(F.col("predicted") == "homozygous", F.col("p_hom")).otherwise(F.col("p_novar"))
        assert out.filter("predicted = label").count() > 110
        assert out.filter(named < F.greatest("p_het", "p_hom", "p_novar")).count() == 0
        assert learning.confident(out, 0.0).count() == 120
    shares, enough = learning.explained_variance(table, ("f_dp", "f_baf"))
    assert sum(shares) == pytest.approx(1) and enough in (1, 2)
    split = learning.split(table)
    assert split.filter("is_test").groupBy("label").count().collect()[0]["count"] == 8
    tags = learning.tagged(out.withColumn("info", F.lit("DP=1")), "MLP").first()["info"]
    assert tags.startswith("DP=1;MLP_CLASS=") and "MLP_HOMO=" in tags


def test_grid_search_uses_variant_f1(spark):
    rows = [("1", i, "A", "C", learning.CLASSES[i % 3], float(i % 3)) for i in range(60)]
    table = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, label string, f_dp double")
    model = learning.train(table, "forest", ("f_dp",), grid=True)
    assert max(model.avgMetrics) == pytest.approx(1.0)


def test_reports(spark):
    rows = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (0.999,)], "baf double")
    assert {r["bin"]: r["n"] for r in reports.baf_histogram(rows).collect()} == {0: 1, 1: 1, 19: 2}
    table = reports.confusion(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string"))
    report = {r["class"]: r for r in reports.class_report(table).collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["b"]["precision"]) == (1.0, 0.5, 0.5)
    assert reports.accuracy(table).first()["accuracy"] == pytest.approx(2 / 3)


def test_matrix(spark):
    snvs = spark.createDataFrame([("a", "1", 5), ("a", "1", 5), ("b", "2", 6)], "barcode string, chrom string, pos int")
    assert {tuple(r) for r in matrix.pivoted(snvs, ["1_5", "2_6"]).collect()} == {("a", 1, 0), ("b", 0, 1)}
    assert [r["snv"] for r in matrix.columns(snvs.unionByName(snvs.withColumn("pos", F.lit(10)))).orderBy("place").collect()] == ["1_10", "1_5", "2_10", "2_6"]


def test_matrix_blocks_hold_every_pair(spark):
    snvs = spark.createDataFrame([("a", "1", p) for p in range(100, 170)] + [("b", "1", 101), ("b", "1", 101)], "barcode string, chrom string, pos int")
    names = [r["snv"] for r in matrix.columns(snvs).orderBy("place").collect()]
    rows = matrix.blocks(snvs).collect()
    found = {(r["barcode"], names[matrix.BLOCK * r["block"] + i]) for r in rows for i in range(matrix.BLOCK) if r["present"] >> i & 1}
    assert len(rows) == 4 and found == {("a", f"1_{p}") for p in range(100, 170)} | {("b", "1_101")}


def test_numbered_with_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("x", 3), ("x", 1), (None, 2), (None, None), ("x", 1)], "g string, k int")
    got = sorted((r["g"] or "", r["place"], r["k"] or 0, r["among"]) for r in ordering.numbered(rows, ["k"], ["g"]).collect())
    assert got == [("", 0, 0, 2), ("", 1, 2, 2), ("x", 0, 1, 3), ("x", 1, 1, 3), ("x", 2, 3, 3)]
    assert [r["place"] for r in ordering.numbered(rows, ["k"]).orderBy("place").collect()] == [0, 1, 2, 3, 4]
    assert ordering.numbered(rows.limit(0), ["k"], ["g"]).count() == 0


def test_a_model_is_kept_and_loaded(spark, tmp_path):
    rows = [("1", i, "A", "C", learning.CLASSES[i % 3], float(i % 3)) for i in range(30)]
    table = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, label string, f_dp double")
    model = learning.train(table, "forest", ("f_dp",))
    learning.save(model, str(tmp_path / "model"))
    again = learning.classified(learning.load(str(tmp_path / "model")), table)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, learning.classified(model, table).collect()))


def test_readers_and_sinks_round_trip(spark, tmp_path):
    variants = records(spark, GOLDEN[:3]).withColumn("chrom", F.lit("chr2"))
    sinks.write_vcf(variants, str(tmp_path / "vcf"))
    back = readers.vcf(spark, str(tmp_path / "vcf"))
    assert sorted(map(tuple, back.select(*readers.VCF_COLUMNS).collect())) == sorted(map(tuple, variants.collect()))
    assert readers.chromosome(back, "2").count() == 3
    folder = tmp_path / "snvs"
    folder.mkdir()
    (folder / "AAA-1.txt").write_text("chr1 5 A C\n1 6\nbad\n")
    (folder / "all_filtered_variants.txt").write_text("Chrom Pos Ref Alt\n1 5 A C\n")
    assert sorted(map(tuple, readers.spot_snvs(spark, str(folder)).collect())) == [("AAA-1", "1", 5, "A", "C"), ("AAA-1", "1", 6, "N", "N")]
    (tmp_path / "pos.csv").write_text("b1,1,0,0,10.5,20.5\nb2,0,1,1,1,2\n")
    assert readers.positions(spark, str(tmp_path / "pos.csv")).count() == 2
    (tmp_path / "scale.json").write_text('{\n"tissue_hires_scalef": 0.2\n}')
    assert readers.scale_factors(spark, str(tmp_path / "scale.json")) == {"spot_diameter_fullres": 100.0, "tissue_hires_scalef": 0.2}
    (tmp_path / "missing.txt").write_text("b3 extra\n\nb4\n")
    assert {r[0] for r in readers.missing_barcodes(spark, str(tmp_path / "missing.txt")).collect()} == {"b3", "b4"}
    (tmp_path / "codes.tsv").write_text("b3\tx\n \nb4\n")
    assert readers.barcode_list(spark, str(tmp_path / "codes.tsv")).count() == 2
    for name in ("b3.bam", "b5.bam"):
        (tmp_path / name).write_bytes(b"x")
    files = readers.files_of(spark, str(tmp_path / "*.bam"))
    assert [r["barcode"] for r in readers.existing(readers.barcode_list(spark, str(tmp_path / "codes.tsv")), files).collect()] == ["b3"]
    table = spark.createDataFrame([(1, "b", "1", 5, 9, False, 30, 20), (2, "b", "1", 5, 9, False, 3, 20)], readers.READ_SCHEMA)
    sinks.write_reads(table, str(tmp_path / "reads"))
    assert readers.reads(spark, str(tmp_path / "reads"), min_mapq=10, chrom="1").count() == 1
    pairs = spark.createDataFrame([("b", "1", 10, "A", "C"), ("b", "1", 9, "A", "C")], "barcode string, chrom string, pos int, ref string, alt string")
    sinks.write_spot_snvs(pairs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2 and sinks.union_of_spots(pairs).count() == 2
    sinks.write_split(pairs, str(tmp_path / "split"), "alt")
    sinks.write_csv(pairs, str(tmp_path / "csv"))
    name = sinks.matrix_name("D", "1", "ours", "all", "spot")
    assert name == "D_1_ours_all_spot_matrix"
    assert spark.read.parquet(sinks.write_matrix(matrix.long(pairs), str(tmp_path), name)).count() == 2
    raced = sinks.with_race(pairs.withColumns({"info": F.lit("."), "race": F.lit("denovo")})).first()
    assert (raced["chrom"], raced["info"], raced["sample"]) == ("chr1", ".;RACE=denovo", "./.")
    summed = sinks.with_frequency(pairs.withColumns({"info": F.lit("."), "n_barcodes": F.lit(2), "freq": F.lit(0.5)})).first()
    assert summed["info"] == "COUNT=2;FREQ=0.5000"


def test_config(tmp_path):
    raw = """
sections: {ids: [1, 2]}
tissue: somatic
reference: {chr_prefix: chr, build: hg19}
paths: {base: "/data/{dataset}", bam: "{base}/{section}.bam"}
spatial: {diameter: 10, section_overrides: {"2": {diameter: 20}}}
quality_filter: {DP: 0, GQ: 8}
thousand_genomes: {pattern: "{base}/{chrom}.vcf"}
"""
    (tmp_path / "TOY.yaml").write_text(raw)
    one, two = config.all_sections(str(tmp_path), "toy")
    assert (one.section, one.regions[0], len(one.regions), one.is_somatic, one.is_germline) == ("1", "chr1", 22, True, False)
    assert (two.spatial["diameter"], two.paths["bam"], two.quality_text) == (20, "/data/TOY/2.bam", "DP0_GQ8")
    assert one.panel_path("chr7") == "/data/TOY/7.vcf"
    with pytest.raises(ValueError, match="no section"):
        config.load(str(tmp_path), "toy", "9")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    query = streaming.stream(spark, str(tmp_path / "in"), late="1000 days").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, streaming.windowed(events).collect()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (5, 5), (300, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipelines_end_to_end(spark, sf_dir):
    from lociq.plans import views

    variants, sites = views.variants(spark, sf_dir), views.site_reads(spark, sf_dir)
    intervals = sites.select("read_id", "barcode", "chrom", (F.col("pos") - 1).alias("start0"), F.col("pos").alias("end0"), F.lit(False).alias("unmapped"))
    inputs = pipelines.Inputs(variants, views.phased(spark, sf_dir), intervals, views.spots(spark, sf_dir), known=views.panel(spark, sf_dir), exclude=views.panel(spark, sf_dir).filter("pos % 9 = 0"), kept=views.panel(spark, sf_dir).filter("pos % 50 = 1"))
    out = pipelines.somatic(inputs, spot_diameter=0.03)
    assert out["supported"].count() <= out["detected"].count() and out["matrix"].count() > 0
    full = pipelines.germline(inputs, spot_diameter=0.03, training_rows=500)
    assert full["counts"].count() == full["edges"].select("src").distinct().count() + full["counts"].join(full["edges"], F.col("barcode") == F.col("src"), "left_anti").count()
    assert full["pool"].count() > 0
