"""All registered queries of the variant engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import fields
from lociq.operators import callers, genotype, learning, left_align, matrix, panel, pileup, reads, reports, spatial, transitions
from lociq.plans import views
from lociq.scratch import new_path, stored
from lociq.sources import readers, sinks
from lociq.streaming import counts as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None, once: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` may use the views of plans.views (and add some: then it
    begins with a comma). The views named in ``once`` are used in several places and written once."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with views.once(*once):
                return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH {views.SQL}{sql}" if sql.startswith(",") else f"WITH {views.SQL} {sql}"
        return f

    return add


@views.shared
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.transitions(views.calls(spark, sf_dir), views.phased(spark, sf_dir))


@views.shared
def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.error_status(views.calls(spark, sf_dir), transitions.thresholds(_changes(spark, sf_dir)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.graph(views.spots(spark, sf_dir), views.RADIUS2**0.5)


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.first_overlaps(views.interval_reads(spark, sf_dir), views.target_positions(spark, sf_dir))


@views.shared
def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.detected(_overlaps(spark, sf_dir), views.target_positions(spark, sf_dir))


@views.shared
def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.supported(views.spot_snvs(spark, sf_dir), _edges(spark, sf_dir), views.spots(spark, sf_dir))


# Genotype calling


@_query("SELECT chrom, pos, ref, alt, gt, gq, dp FROM calls")
def gt_call(spark, sf_dir):
    return views.calls(spark, sf_dir).select("chrom", "pos", "ref", "alt", "gt", "gq", "dp")


@_query("""SELECT chrom, pos, ref, alt, CASE WHEN f = '' THEN 'PASS' ELSE f END AS filter FROM (SELECT *, concat_ws(';', CASE WHEN dp < 25 THEN 'LowDP' END, CASE WHEN gq < 12 THEN 'LowGQ' END, CASE WHEN qual < 60 THEN 'LowQual' END,
    CASE WHEN NOT CASE gt WHEN '0/1' THEN baf BETWEEN 0.35 AND 0.65 ELSE baf >= 0.85 END THEN 'DiscordantBAF' END) AS f FROM calls)""")
def gt_filter_flags(spark, sf_dir):
    return genotype.called(views.variants(spark, sf_dir), 25, 12, 60.0).select("chrom", "pos", "ref", "alt", "filter")


@_query("SELECT chrom, pos, ref, alt, baf, qual FROM calls")
def gt_baf(spark, sf_dir):
    return views.calls(spark, sf_dir).select("chrom", "pos", "ref", "alt", "baf", "qual")


@_query("SELECT chrom, pos, ref, alt, replace(chrom, 'chr', '') AS bare, 'GT:GQ:BAF:PL' AS format FROM calls")
def gt_prefix(spark, sf_dir):
    rows = genotype.annotated_sample(views.calls(spark, sf_dir))
    bare = fields.bare_chrom(F.col("chrom"))
    return rows.select(fields.prefixed_chrom(bare).alias("chrom"), "pos", "ref", "alt", bare.alias("bare"), "format")


@_query("SELECT chrom, pos, ref, alt FROM sites WHERE NOT (pos % 7 = 0 OR pos % 11 = 0 OR pos % 13 = 0)")
def site_filter(spark, sf_dir):
    rows = views.variants(spark, sf_dir).withColumns({
        "ref": F.when(F.col("pos") % 7 == 0, F.concat("ref", F.lit("A"))).otherwise(F.col("ref")),
        "alt": F.when(F.col("pos") % 11 == 0, F.concat("alt", F.lit(",<X>"))).otherwise(F.col("alt")),
        "info": F.when(F.col("pos") % 13 == 0, F.concat(F.lit("INDEL;"), "info")).otherwise(F.col("info")),
    })
    return genotype.snv_sites(rows).select("chrom", "pos", "ref", "alt")


@_query("""SELECT chrom, pos, ref, alt, (k * (k + 1) / 2)::INTEGER AS het, (k * (k + 1) / 2)::INTEGER + k::INTEGER AS hom
    FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, ref ORDER BY alt) AS k, count(*) OVER (PARTITION BY chrom, pos, ref) AS n FROM sites) WHERE n >= 2""")
def multiallelic_split(spark, sf_dir):
    several = views.variants(spark, sf_dir).groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_list("alt")).alias("a")).filter(F.size("a") >= 2)
    rows = several.select("chrom", "pos", "ref", F.concat_ws(",", "a").alias("alt"), F.array(*[F.lit(i) for i in range(10)]).alias("pl"))  # at most three alleles
    return genotype.split_multiallelic(rows).select("chrom", "pos", "ref", "alt", F.get("pl", F.lit(1)).alias("het"), F.get("pl", F.lit(2)).alias("hom"))


@_query("""SELECT chrom, pos, ref, alt, CASE pos % 10 WHEN 0 THEN 'likelihoods' WHEN 1 THEN 'quality' ELSE 'depth' END AS reason FROM sites WHERE pos % 10 < 3""")
def gt_rejected(spark, sf_dir):
    rows = views.variants(spark, sf_dir).withColumns({
        "sample": F.when(F.col("pos") % 10 == 0, "1,2").otherwise(F.col("sample")),
        "qual": F.when(F.col("pos") % 10 == 1, "high").otherwise(F.col("qual")),
        "info": F.when(F.col("pos") % 10 == 2, F.regexp_replace("info", "DP=[0-9]+", "DP=many")).otherwise(F.col("info")),
    })
    return genotype.rejected(rows).select("chrom", "pos", "ref", "alt", "reason")


@_query("SELECT chrom, count(*) AS snp_count FROM calls GROUP BY chrom")
def region_counts(spark, sf_dir):
    return reports.per_region(views.calls(spark, sf_dir))


# Panel and pools


@_query("SELECT c.chrom, c.pos, c.ref, c.alt, c.gt FROM calls c SEMI JOIN panel p USING (chrom, pos, ref, alt)", once=("calls",))
def panel_defined(spark, sf_dir):
    return panel.defined(views.calls(spark, sf_dir), views.panel(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "gt")


@_query("SELECT c.chrom, c.pos, c.ref, c.alt, c.gt FROM calls c ANTI JOIN panel p USING (chrom, pos, ref, alt)", once=("calls",))
def panel_denovo(spark, sf_dir):
    return panel.denovo(views.calls(spark, sf_dir), views.panel(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "gt")


@_query("SELECT CASE WHEN pos % 3 <> 0 THEN 'defined' ELSE 'denovo' END AS origin, count(*) AS n FROM calls GROUP BY 1", once=("calls",))
def panel_origin(spark, sf_dir):
    return panel.with_origin(views.calls(spark, sf_dir), views.panel(spark, sf_dir)).groupBy("origin").agg(F.count("*").alias("n"))


@_query("SELECT chrom, pos, ref, alt FROM panel UNION SELECT chrom, pos, ref, alt FROM calls WHERE pos % 2 = 0", once=("calls",))
def panel_keys(spark, sf_dir):
    return panel.keys(views.panel(spark, sf_dir), views.calls(spark, sf_dir).filter("pos % 2 = 0"))


@_query("SELECT p.chrom, p.pos, p.ref, p.alt, p.gt, c.dp, c.gq FROM phased p LEFT JOIN calls c ON p.chrom = c.chrom AND p.pos = c.pos AND p.ref = c.ref AND p.alt = c.alt AND c.pos % 4 <> 0", once=("calls",))
def back_annotated(spark, sf_dir):
    rows = panel.back_annotated(views.phased(spark, sf_dir), views.calls(spark, sf_dir).filter("pos % 4 <> 0"), ["dp", "gq"])
    return rows.select("chrom", "pos", "ref", "alt", "gt", "dp", "gq")


@_query("""SELECT replace(chrom, 'chr', '') AS chrom, pos, ref, alt, CASE WHEN pos % 3 <> 0 THEN 'defined' ELSE 'denovo' END AS race FROM calls WHERE pos % 3 <> 0 OR pos % 2 = 0""", once=("calls",))
def pool_dedupe(spark, sf_dir):
    calls = views.calls(spark, sf_dir)
    return panel.pool([("defined", views.panel(spark, sf_dir)), ("denovo", calls.filter("pos % 2 = 0").withColumn("chrom", fields.bare_chrom(F.col("chrom"))))])


@_query("SELECT chrom, pos, ref, alt, gt FROM phased WHERE gt IN ('0/1', '1/1')")
def valid_genotypes(spark, sf_dir):
    return panel.valid_genotypes(views.phased(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "gt")


@_query("SELECT count(*) FILTER (gt = '0/1') AS n_het, count(*) FILTER (gt = '1/1') AS n_hom FROM calls")
def genotype_counts(spark, sf_dir):
    return panel.genotype_counts(views.calls(spark, sf_dir))


@_query("""SELECT a AS n_a, b AS n_b, c AS n_both, a + b - c AS n_union, c::DOUBLE / (a + b - c) AS jaccard FROM (SELECT count(*) FILTER (pos % 3 <> 0) AS a, count(*) FILTER (pos % 2 = 0) AS b, count(*) FILTER (pos % 6 IN (2, 4)) AS c FROM calls)""", once=("calls",))
def caller_jaccard(spark, sf_dir):
    return panel.overlap(views.panel(spark, sf_dir), views.calls(spark, sf_dir).filter("pos % 2 = 0"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of 20 bases with a unit that repeats for each part, 500 to a chromosome."""
    key = F.col("p_partkey")
    unit = F.substring(F.lit("ACGTTGCACCATGGAATTCC"), (key % 17 + 1).cast("int"), (key % 3 + 1).cast("int"))
    chrom = F.concat(F.lit("chr"), (F.floor(key / 500) + 1).cast("string"))
    return views.table(spark, sf_dir, "part").select(chrom.alias("chrom"), (key % 500 * 20 + 1).alias("start"), F.left(F.repeat(unit, F.lit(20)), F.lit(20)).alias("seq"), key.alias("l_partkey"))


def _indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion, an insertion of what follows or another base for each line item, somewhere in its part's stretch."""
    rows = views.table(spark, sf_dir, "lineitem").join(_reference(spark, sf_dir), "l_partkey")
    size = (F.col("l_suppkey") % 3 + 1).cast("int")
    at = (F.col("l_orderkey") % 16 + 1).cast("int")
    base, some = F.substring("seq", at, F.lit(1)), F.substring("seq", at, size + 1)
    other = F.translate(base, "ACGT", "CGTA")
    kind = F.col("l_linenumber") % 3
    ref = F.when(kind == 0, some).otherwise(base)
    alt = F.when(kind == 0, base).when(kind == 1, some).otherwise(other)
    return rows.select("chrom", (F.col("start") + at - 1).cast("int").alias("pos"), ref.alias("ref"), alt.alias("alt")).distinct()


@_query(""", reference AS (SELECT 'chr' || (p_partkey // 500 + 1) AS chrom, p_partkey % 500 * 20 + 1 AS start, left(repeat(substr('ACGTTGCACCATGGAATTCC', (p_partkey % 17 + 1)::INTEGER, (p_partkey % 3 + 1)::INTEGER), 20), 20) AS seq, p_partkey FROM part),
    whole AS (SELECT chrom, string_agg(seq, '' ORDER BY start) AS bases FROM reference GROUP BY chrom),
    drawn AS (SELECT DISTINCT chrom, start + l_orderkey % 16 AS p, l_linenumber % 3 AS kind, substr(seq, (l_orderkey % 16 + 1)::INTEGER, CASE WHEN l_linenumber % 3 = 2 THEN 1 ELSE (l_suppkey % 3 + 2)::INTEGER END) AS piece FROM lineitem JOIN reference ON p_partkey = l_partkey),
    flanked AS (SELECT chrom, p, kind, piece, bases, substr(piece, 2) AS s, substr(bases, greatest(p - 299, 1), least(p, 300)) AS l FROM drawn JOIN whole USING (chrom)),
    moved AS (SELECT *, CASE kind WHEN 2 THEN 0 ELSE coalesce(list_filter(range(1, 301), lambda i: substr(l, -i, 1) <> substr(l || s, -i, 1))[1], 301) - 1 END AS k FROM flanked),
    turned AS (SELECT *, substr(l || s, length(l) - k + 1, length(s)) AS t, substr(l, -k - 1, 1) AS anchor FROM moved),
    final AS (SELECT *, CASE WHEN p - k >= 1 THEN anchor ELSE '' END AS head, CASE WHEN p - k >= 1 THEN '' ELSE substr(bases, CASE kind WHEN 0 THEN length(s) + 1 ELSE 1 END, 1) END AS tail FROM turned)
    SELECT chrom, (CASE kind WHEN 2 THEN p ELSE greatest(p - k, 1) END)::INTEGER AS pos, CASE kind WHEN 2 THEN piece WHEN 0 THEN head || t || tail ELSE head || tail END AS ref,
        CASE kind WHEN 2 THEN translate(piece, 'ACGT', 'CGTA') WHEN 0 THEN head || tail ELSE head || t || tail END AS alt, true AS aligned FROM final""")
def left_aligned_variants(spark, sf_dir):
    return left_align.left_aligned(_indels(spark, sf_dir), left_align.tiles(_reference(spark, sf_dir)))


_CIGARS = ("20M", "3S10M2I5M", "5M3D10M300N5M", "8M2D12M")


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 20 bases for each line item."""
    cigar = F.element_at(F.array(*map(F.lit, _CIGARS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    bases = F.substring(F.lit("ACGTTGCACCATGGAATTCCACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(20))
    return views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.concat(F.lit("chr"), (F.col("l_partkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("l_partkey") * 3).cast("int").alias("start0"), cigar.alias("cigar"),
        bases.alias("bases"), F.repeat(F.char(33 + F.col("l_quantity").cast("int") % 41), F.lit(20)).alias("quals"), (F.col("l_orderkey") % 60).cast("int").alias("mapq"), (F.col("l_returnflag") == "R").alias("reverse"), (F.col("l_suppkey") % 7 == 0).alias("unmapped"),
    )


@_query("""SELECT chrom, pos, base, reverse, count(*) AS n, sum(q)::BIGINT AS sum_q, sum(q * q)::BIGINT AS sum2_q, sum(mapq)::BIGINT AS sum_mapq, sum(mapq * mapq)::BIGINT AS sum2_mapq, sum(tail)::BIGINT AS sum_tail, sum(tail * tail)::BIGINT AS sum2_tail FROM (
    SELECT 'chr' || (l_partkey % 22 + 1) AS chrom, (l_partkey * 3 + 1 + ref + i)::INTEGER AS pos, substr('ACGTTGCACCATGGAATTCCACGT', (l_suppkey % 4 + 1 + read + i)::INTEGER, 1) AS base, l_returnflag = 'R' AS reverse, l_quantity::INTEGER % 41 AS q, l_orderkey % 60 AS mapq, least(read + i, 19 - read - i) AS tail
    FROM lineitem JOIN (VALUES (0, 0, 0, 20), (1, 0, 3, 10), (1, 10, 15, 5), (2, 0, 0, 5), (2, 8, 5, 10), (2, 318, 15, 5), (3, 0, 0, 8), (3, 10, 8, 12)) b(kind, ref, read, len) ON kind = l_linenumber % 4, (SELECT unnest(range(20)) AS i)
    WHERE i < len AND l_suppkey % 7 <> 0 AND l_orderkey % 60 >= 20 AND l_quantity::INTEGER % 41 >= 13) GROUP BY ALL""")
def pileup_columns(spark, sf_dir):
    return pileup.columns(_alignments(spark, sf_dir), min_mapq=20, min_baseq=13)


_CALLERS = ["alt", "long", "panel"]


def _three_callers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three callers by what they take for evidence of a called site in a spot, folded; and all spots with their slides."""
    slide = F.floor(F.substring("barcode", F.lit(2), F.length("barcode")).cast("long") / views.SLIDE)
    seen = views.site_reads(spark, sf_dir).join(views.calls(spark, sf_dir).select(*panel.KEY), list(panel.KEY), "left_semi")
    by = F.array_compact(F.array(F.when(F.col("is_alt") & (F.col("length") > 45), "alt"), F.when(F.col("length") >= 40, "long"), F.when(F.col("pos") % 3 != 0, "panel")))
    rows = seen.select(slide.alias("slide"), "barcode", *panel.KEY, F.explode(by).alias("caller"))
    return callers.folded(rows, _CALLERS, ("slide",)), views.spots(spark, sf_dir).select(slide.alias("slide"), "barcode")


_MASKS = """called AS (SELECT substr(barcode, 2)::BIGINT // 500 AS slide, r.* FROM reads r SEMI JOIN calls c USING (chrom, pos, ref, alt)),
masks AS (SELECT * FROM (SELECT slide, barcode, chrom, pos, ref, alt, bool_or(is_alt AND length > 45) AS a, bool_or(length >= 40) AS l, bool_or(pos % 3 <> 0) AS p FROM called GROUP BY ALL) WHERE a OR l OR p),
sizes AS (SELECT s.slide, s.barcode, count(*) FILTER (a) AS n_alt, count(*) FILTER (l) AS n_long, count(*) FILTER (p) AS n_panel, count(*) FILTER (a AND l) AS both_alt_long, count(*) FILTER (a AND p) AS both_alt_panel,
    count(*) FILTER (l AND p) AS both_long_panel, count(*) FILTER (a AND l AND p) AS n_all, count(*) FILTER (l OR p) AS n_consensus, count(*) FILTER (a AND (l OR p)) AS n_hit
    FROM (SELECT substr(barcode, 2)::BIGINT // 500 AS slide, barcode FROM spots) s LEFT JOIN masks USING (slide, barcode) GROUP BY ALL),
each AS (SELECT *, coalesce(both_alt_long / nullif(n_alt + n_long - both_alt_long, 0), 0)::DOUBLE AS jaccard_alt_long, coalesce(both_alt_panel / nullif(n_alt + n_panel - both_alt_panel, 0), 0)::DOUBLE AS jaccard_alt_panel,
    coalesce(both_long_panel / nullif(n_long + n_panel - both_long_panel, 0), 0)::DOUBLE AS jaccard_long_panel, coalesce(n_hit / nullif(n_consensus, 0), 0)::DOUBLE AS recall, coalesce(n_hit / nullif(n_alt, 0), 0)::DOUBLE AS precision,
    coalesce(2 * n_hit / nullif(n_consensus + n_alt, 0), 0)::DOUBLE AS f1 FROM sizes)"""


@_query(f", {_MASKS} SELECT * FROM each")
def caller_overlap_spots(spark, sf_dir):
    """All spots, those without any variant too."""
    masks, spots = _three_callers(spark, sf_dir)
    return callers.per_spot(masks, spots, _CALLERS, "alt", by=("slide",))


@_query(f""", {_MASKS}, united AS (SELECT slide, bool_or(a) AS a, bool_or(l) AS l, bool_or(p) AS p FROM masks GROUP BY slide, chrom, pos, ref, alt)
    SELECT e.slide, n_spots, n_spots_with_alt, n_spots_with_long, n_spots_with_panel, union_alt, union_long, union_panel, union_all, both_alt_long, both_alt_panel, both_long_panel,
    round(both_alt_long / (union_alt + union_long - both_alt_long), 9) AS jaccard_union_alt_long, round(both_alt_panel / (union_alt + union_panel - both_alt_panel), 9) AS jaccard_union_alt_panel, round(both_long_panel / (union_long + union_panel - both_long_panel), 9) AS jaccard_union_long_panel,
    jaccard_alt_long_mean, jaccard_alt_panel_mean, jaccard_long_panel_mean, recall_alt_consensus_mean, precision_alt_consensus_mean, f1_alt_consensus_mean
    FROM (SELECT slide, count(*) AS n_spots, count(*) FILTER (n_alt > 0) AS n_spots_with_alt, count(*) FILTER (n_long > 0) AS n_spots_with_long, count(*) FILTER (n_panel > 0) AS n_spots_with_panel, round(avg(jaccard_alt_long), 9) AS jaccard_alt_long_mean,
        round(avg(jaccard_alt_panel), 9) AS jaccard_alt_panel_mean, round(avg(jaccard_long_panel), 9) AS jaccard_long_panel_mean, round(avg(recall), 9) AS recall_alt_consensus_mean, round(avg(precision), 9) AS precision_alt_consensus_mean, round(avg(f1), 9) AS f1_alt_consensus_mean FROM each GROUP BY slide) e
    JOIN (SELECT slide, count(*) FILTER (a) AS union_alt, count(*) FILTER (l) AS union_long, count(*) FILTER (p) AS union_panel, count(*) FILTER (a AND l AND p) AS union_all, count(*) FILTER (a AND l) AS both_alt_long,
        count(*) FILTER (a AND p) AS both_alt_panel, count(*) FILTER (l AND p) AS both_long_panel FROM united GROUP BY slide) u ON u.slide = e.slide""")
def caller_overlap_summary(spark, sf_dir):
    masks, spots = _three_callers(spark, sf_dir)
    summary = callers.section_summary(stored(masks, "masks"), spots, _CALLERS, "alt", by=("slide",))
    return summary.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])


@_query(f""", {_MASKS}, united AS (SELECT slide, bool_or(a) AS a, bool_or(l) AS l, bool_or(p) AS p FROM masks GROUP BY slide, chrom, pos, ref, alt)
    SELECT slide, callers, n_exactly, n_together FROM (SELECT slide, concat_ws('+', CASE WHEN x THEN 'alt' END, CASE WHEN y THEN 'long' END, CASE WHEN z THEN 'panel' END) AS callers, count(*) FILTER (x = a AND y = l AND z = p) AS n_exactly,
        count(*) FILTER ((a OR NOT x) AND (l OR NOT y) AND (p OR NOT z)) AS n_together FROM united, (SELECT unnest([true, false]) AS x), (SELECT unnest([true, false]) AS y), (SELECT unnest([true, false]) AS z) WHERE x OR y OR z GROUP BY ALL) WHERE n_together > 0""")
def caller_set_sizes(spark, sf_dir):
    return callers.set_sizes(_three_callers(spark, sf_dir)[0], _CALLERS, ("slide",))


# Transitions and the error model


@_query("SELECT chrom, pos, ref, alt, gt FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY ord DESC) AS place FROM phased) WHERE place = 1")
def phased_last(spark, sf_dir):
    return panel.last_of_each(views.phased(spark, sf_dir), ["chrom", "pos"], F.col("ord")).select("chrom", "pos", "ref", "alt", "gt")


@_query("SELECT orig_gt, new_gt, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percentage FROM transitions GROUP BY orig_gt, new_gt", once=("calls",))
def transition_counts(spark, sf_dir):
    return transitions.counts(_changes(spark, sf_dir))


@_query("SELECT orig_gt, new_gt, ref, alt, count(*) AS n FROM transitions GROUP BY ALL", once=("calls",))
def transition_detail(spark, sf_dir):
    return transitions.detail(_changes(spark, sf_dir))


@_query("SELECT chrom, pos, ref, alt, orig_gt, new_gt FROM transitions WHERE (orig_gt, new_gt) IN (('0/1', '0/0'), ('0/1', '1/1'), ('1/1', '0/0'), ('1/1', '0/1'), ('0/0', '0/1'))", once=("calls",))
def shifted_variants(spark, sf_dir):
    return transitions.shifted(_changes(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "orig_gt", "new_gt")


@_query("SELECT chrom, pos, ref, alt, orig_gt FROM transitions WHERE orig_gt = new_gt", once=("calls",))
def stable_variants(spark, sf_dir):
    return transitions.stable(_changes(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "orig_gt")


@_query("SELECT ref, alt, orig_gt, round(baf_thr, 9) AS baf_thr, depth_thr, n FROM learned", once=("calls",))
def transition_thresholds(spark, sf_dir):
    return transitions.thresholds(_changes(spark, sf_dir)).select("ref", "alt", "orig_gt", F.round("baf_thr", 9).alias("baf_thr"), F.col("depth_thr").cast("double").alias("depth_thr"), "n")


@_query("SELECT ref, alt, orig_gt, round(baf_thr, 9) AS baf_thr, depth_thr, n FROM learned", once=("calls", "changes"))
def thresholds_from_counts(spark, sf_dir):
    """Three sections' value counts, added up."""
    changes = _changes(spark, sf_dir)
    sections = [transitions.value_counts(changes.filter(F.col("pos") % 3 == i)) for i in (2, 0, 1)]
    learned = transitions.thresholds_of(transitions.added(transitions.added(sections[0], sections[1]), sections[2]))
    return learned.select("ref", "alt", "orig_gt", F.round("baf_thr", 9).alias("baf_thr"), "depth_thr", "n")


@_query("""SELECT c.chrom, c.pos, c.ref, c.alt, CASE WHEN gt = '0/0' THEN 'hom_ref' WHEN gt IS NULL OR baf IS NULL OR dp IS NULL THEN 'missing' WHEN coalesce(baf <= baf_thr AND dp <= depth_thr, false) THEN 'error' ELSE 'no_error' END AS status
    FROM (SELECT c.* REPLACE (CASE pos % 11 WHEN 0 THEN '0/0' WHEN 1 THEN NULL ELSE gt END AS gt, CASE WHEN pos % 13 <> 0 THEN dp END AS dp, CASE WHEN pos % 17 <> 0 THEN baf END AS baf) FROM calls c) c
    LEFT JOIN learned l ON c.ref = l.ref AND c.alt = l.alt AND c.gt = l.orig_gt""", once=("calls", "changes"))
def seq_error_missing(spark, sf_dir):
    """Rows called 0/0, and rows without genotype, depth or share."""
    calls = views.calls(spark, sf_dir).withColumns({
        "gt": F.when(F.col("pos") % 11 == 0, "0/0").when(F.col("pos") % 11 != 1, F.col("gt")), "dp": F.when(F.col("pos") % 13 != 0, F.col("dp")), "baf": F.when(F.col("pos") % 17 != 0, F.col("baf")),
    })
    return transitions.error_status(calls, transitions.thresholds(_changes(spark, sf_dir))).select("chrom", "pos", "ref", "alt", "status")


@_query("SELECT chrom, pos, ref, alt, gt, status, CASE WHEN status = 'error' THEN CASE gt WHEN '0/1' THEN 'HET' ELSE 'HOM' END END AS seq_error_model FROM judged", once=("calls", "changes"))
def seq_error_status(spark, sf_dir):
    return _judged(spark, sf_dir).select("chrom", "pos", "ref", "alt", "gt", "status", "seq_error_model")


@_query("""SELECT *, 100 * ((het_error + hom_error)::DOUBLE / (total - hom_ref)) AS error_pct FROM (SELECT count(*) AS total, count(*) FILTER (gt = '0/1') AS het_total, count(*) FILTER (gt = '1/1') AS hom_total,
    count(*) FILTER (status = 'error' AND gt = '0/1') AS het_error, count(*) FILTER (status = 'error' AND gt = '1/1') AS hom_error, count(*) FILTER (status = 'no_error') AS no_error,
    count(*) FILTER (status = 'hom_ref') AS hom_ref, count(*) FILTER (status = 'missing') AS missing_info FROM judged)""", once=("calls", "changes"))
def seq_error_summary(spark, sf_dir):
    return transitions.error_summary(_judged(spark, sf_dir))


@_query("""SELECT orig_gt, new_gt, bin, n, n / (sum(n) OVER (PARTITION BY orig_gt, new_gt) * 0.05::DOUBLE) AS density FROM
    (SELECT orig_gt, new_gt, least(floor(baf / 0.05::DOUBLE), 19)::INTEGER AS bin, count(*) AS n FROM transitions GROUP BY ALL)""", once=("calls",))
def baf_histogram(spark, sf_dir):
    return reports.baf_histogram(_changes(spark, sf_dir), ["orig_gt", "new_gt"])


@_query("SELECT bin, n, n / (sum(n) OVER () * 10.0::DOUBLE) AS density FROM (SELECT least(floor(least(depth, 200) / 10.0::DOUBLE), 19)::INTEGER AS bin, count(*) AS n FROM transitions GROUP BY ALL)", once=("calls",))
def depth_histogram(spark, sf_dir):
    return reports.depth_histogram(_changes(spark, sf_dir))


# Reads


@_query("SELECT read_id, barcode, pos FROM hits")
def range_detect(spark, sf_dir):
    return _overlaps(spark, sf_dir).select("read_id", "barcode", "pos")


@_query("SELECT i.barcode, count(*) AS n_kept FROM intervals i WHERE read_id IN (SELECT read_id FROM hits) GROUP BY i.barcode", once=("site_reads",))
def reads_kept(spark, sf_dir):
    return reads.kept_reads(views.interval_reads(spark, sf_dir), _overlaps(spark, sf_dir)).groupBy("barcode").agg(F.count("*").alias("n_kept"))


@_query("SELECT barcode, chrom, pos, ref, alt FROM detected", once=("target_positions",))
def detected_snvs(spark, sf_dir):
    return _detected(spark, sf_dir)


@_query("""SELECT d.barcode, d.chrom, d.pos, d.ref, d.alt, coalesce(a.info, '.') AS info, coalesce(a.race, 'unknown') AS race FROM detected d
    LEFT JOIN (SELECT pos, ref, alt, 'P=' || pos AS info, 'defined' AS race FROM targets WHERE pos % 2 = 0) a ON a.pos = d.pos AND a.ref = d.ref AND a.alt = d.alt""", once=("target_positions",))
def detected_annotated(spark, sf_dir):
    pool = views.target_positions(spark, sf_dir).filter("pos % 2 = 0").select("chrom", "pos", "ref", "alt", F.concat(F.lit("P="), F.col("pos").cast("string")).alias("info"), F.lit("defined").alias("race"))
    return reads.with_annotation(_detected(spark, sf_dir), pool).select("barcode", "chrom", "pos", "ref", "alt", "info", "race")


@_query("SELECT chrom, pos, ref, alt, count(DISTINCT barcode) AS n_barcodes, count(DISTINCT barcode)::DOUBLE / (SELECT count(DISTINCT barcode) FROM detected) AS freq FROM detected GROUP BY chrom, pos, ref, alt", once=("target_positions", "detected"))
def variant_barcode_freq(spark, sf_dir):
    return reads.barcode_frequency(_detected(spark, sf_dir))


@_query("SELECT chrom, pos, ref, alt, count(DISTINCT barcode) AS n_barcodes, count(DISTINCT barcode)::DOUBLE / (SELECT count(DISTINCT barcode) FROM detected) AS freq, 'B=' || min(barcode) AS info FROM detected GROUP BY chrom, pos, ref, alt", once=("target_positions", "detected"))
def variant_first_info(spark, sf_dir):
    return reads.barcode_frequency(_detected(spark, sf_dir).withColumn("info", F.concat(F.lit("B="), "barcode")))


def _in_order(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    path = new_path(spark, "ordered")
    sinks.write_ordered(rows, path, keys)
    return readers.ordered(spark, path)


@_query("SELECT row_number() OVER (ORDER BY chrom, pos, ref, alt, barcode) - 1 AS place, barcode, chrom, pos, ref, alt FROM (SELECT barcode, '1' AS chrom, pos, ref, alt FROM detected)", once=("target_positions",))
def detected_in_order(spark, sf_dir):
    """One total order over many files, read back: by the chromosome's text, then position."""
    return _in_order(spark, _detected(spark, sf_dir), ["chrom", "pos", "ref", "alt", "barcode"])


@_query("""SELECT row_number() OVER (ORDER BY chrom, pos, ref, alt) - 1 AS place, chrom, pos, ref, alt, 'B=' || min(barcode) || ';COUNT=' || count(DISTINCT barcode) AS info FROM detected GROUP BY chrom, pos, ref, alt""", once=("target_positions", "detected"))
def summary_in_order(spark, sf_dir):
    found = reads.barcode_frequency(_detected(spark, sf_dir).withColumn("info", F.concat(F.lit("B="), "barcode")))
    rows = _in_order(spark, sinks.with_frequency(found).select("chrom", "pos", "ref", "alt", "info"), ["chrom", "pos", "ref", "alt"])
    return rows.select("place", "chrom", "pos", "ref", "alt", F.regexp_replace("info", ";FREQ=.*", "").alias("info"))


@_query("SELECT row_number() OVER (ORDER BY orig_gt, new_gt) - 1 AS place, orig_gt, new_gt, count(*) AS n FROM transitions GROUP BY orig_gt, new_gt", once=("calls",))
def transitions_in_order(spark, sf_dir):
    return _in_order(spark, transitions.counts(_changes(spark, sf_dir)).select("orig_gt", "new_gt", "n"), ["orig_gt", "new_gt"])


# Spots


@_query("SELECT barcode, x, y FROM spots WHERE in_tissue = 1 AND barcode NOT IN ('s3', 's4')")
def in_tissue_spots(spark, sf_dir):
    missing = spark.createDataFrame([("s3",), ("s4",)], "barcode string")
    return spatial.in_tissue(views.spots(spark, sf_dir), missing).select("barcode", "x", "y")


@_query("SELECT src, dst, dist2 FROM edges")
def knn_graph(spark, sf_dir):
    return _edges(spark, sf_dir)


@_query("SELECT barcode, (SELECT count(*) FROM edges WHERE src = barcode) AS degree FROM spots")
def graph_degree(spark, sf_dir):
    return spatial.degrees(views.spots(spark, sf_dir), _edges(spark, sf_dir))


@_query("SELECT avg(d) AS mean, min(d) AS min, max(d) AS max FROM (SELECT (SELECT count(*) FROM edges WHERE src = barcode) AS d FROM spots)")
def graph_stats(spark, sf_dir):
    return spatial.degree_stats(spatial.degrees(views.spots(spark, sf_dir), _edges(spark, sf_dir)))


@_query("SELECT barcode, chrom, pos, support FROM supports", once=("spot_snvs",))
def neighbour_support(spark, sf_dir):
    return spatial.support(views.spot_snvs(spark, sf_dir), _edges(spark, sf_dir))


@_query("SELECT barcode, chrom, pos FROM filtered", once=("spot_snvs",))
def spatial_filter(spark, sf_dir):
    return _filtered(spark, sf_dir)


@_query("""SELECT barcode, chrom, pos FROM supports WHERE (support >= 3 OR (chrom, pos) IN (SELECT (replace(chrom, 'chr', ''), pos) FROM panel WHERE pos % 4 = 1)) AND barcode IN (SELECT barcode FROM spots)""", once=("spot_snvs", "calls"))
def spatial_filter_kept(spark, sf_dir):
    kept = spatial.pool_positions(views.panel(spark, sf_dir).filter("pos % 4 = 1"), allow_multiallelic=True)
    return spatial.supported(views.spot_snvs(spark, sf_dir), _edges(spark, sf_dir), views.spots(spark, sf_dir), 3, kept)


@_query("""SELECT barcode, chrom, pos FROM spot_snvs WHERE (chrom, pos) NOT IN (SELECT (replace(chrom, 'chr', ''), pos) FROM calls WHERE pos % 5 = 0) AND (chrom, pos) IN (SELECT (replace(chrom, 'chr', ''), pos) FROM panel)""", once=("calls",))
def spatial_exclude_include(spark, sf_dir):
    out = spatial.excluded(views.spot_snvs(spark, sf_dir), spatial.pool_positions(views.calls(spark, sf_dir).filter("pos % 5 = 0")))
    return spatial.included(out, spatial.pool_positions(views.panel(spark, sf_dir)))


@_query("""SELECT barcode, chrom, pos FROM supports WHERE (support >= 3 OR pos % 4 = 1 AND (chrom, pos) IN (SELECT (replace(chrom, 'chr', ''), pos) FROM panel)) AND barcode IN (SELECT barcode FROM spots)
    AND (chrom, pos) NOT IN (SELECT (replace(chrom, 'chr', ''), pos) FROM calls WHERE pos % 5 = 0 AND pos % 2 = 0)""", once=("spot_snvs", "calls"))
def spatial_pools_multiallelic(spark, sf_dir):
    """Rows with several alternative alleles are honoured in a kept pool and skipped in an excluded one."""
    several = lambda rows, c: rows.withColumn("alt", F.when(c, F.concat("alt", F.lit(",G"))).otherwise(F.col("alt")))
    kept = spatial.pool_positions(several(views.panel(spark, sf_dir).filter("pos % 4 = 1"), F.lit(True)), allow_multiallelic=True)
    out = spatial.supported(views.spot_snvs(spark, sf_dir), _edges(spark, sf_dir), views.spots(spark, sf_dir), 3, kept)
    return spatial.excluded(out, spatial.pool_positions(several(views.calls(spark, sf_dir).filter("pos % 5 = 0"), F.col("pos") % 2 == 1)))


@_query("SELECT barcode, n_before, n_after FROM counted", once=("spot_snvs", "filtered"))
def spot_counts(spark, sf_dir):
    return spatial.counts(views.spots(spark, sf_dir), views.spot_snvs(spark, sf_dir), _filtered(spark, sf_dir))


@_query("SELECT count(*) AS n_spots, count(*) FILTER (n_after > 0) AS n_nonzero, sum(n_after)::BIGINT AS total, max(n_after) AS max, avg(n_after) AS mean FROM counted", once=("spot_snvs", "filtered"))
def map_summary(spark, sf_dir):
    return spatial.map_summary(spot_counts(spark, sf_dir))


@_query("""SELECT *, 100 * ((snvs_before - snvs_after)::DOUBLE / snvs_before) AS removed_pct, kept_pairs::DOUBLE / spots_after AS mean_kept FROM (SELECT count(*) AS n_spots, count(*) FILTER (n_before > 0) AS spots_before, count(*) FILTER (n_after > 0) AS spots_after,
    max(n_after) AS max_kept, sum(n_after)::BIGINT AS kept_pairs, (SELECT count(DISTINCT (chrom, pos)) FROM spot_snvs) AS snvs_before, (SELECT count(DISTINCT (chrom, pos)) FROM filtered) AS snvs_after FROM counted)""", once=("spot_snvs", "filtered"))
def spatial_statistics(spark, sf_dir):
    return spatial.filter_statistics(spot_counts(spark, sf_dir), views.spot_snvs(spark, sf_dir), _filtered(spark, sf_dir))


@_query("SELECT barcode, y * 0.25 AS x_plot, x * 0.25 AS y_plot FROM spots")
def plot_coordinates(spark, sf_dir):
    return spatial.plot_coordinates(views.spots(spark, sf_dir), 0.25)


# Matrix and sinks


@_query("SELECT DISTINCT barcode, chrom || '_' || pos AS snv FROM filtered", once=("spot_snvs",))
def snv_matrix_long(spark, sf_dir):
    return matrix.long(_filtered(spark, sf_dir))


@_query("SELECT snv, row_number() OVER (ORDER BY snv) - 1 AS place FROM (SELECT DISTINCT chrom || '_' || pos AS snv FROM filtered)", once=("spot_snvs",))
def matrix_columns(spark, sf_dir):
    return matrix.columns(_filtered(spark, sf_dir))


_PIVOTED = ["9_8", "10_9", "11_10", "13_12", "15_14", "no_such"]


@_query("SELECT barcode, " + ", ".join(f"max(CASE WHEN chrom || '_' || pos = '{c}' THEN 1 ELSE 0 END)::INTEGER AS \"{c}\"" for c in sorted(_PIVOTED)) + " FROM filtered GROUP BY barcode", once=("spot_snvs",))
def snv_matrix_pivot(spark, sf_dir):
    return matrix.pivoted(_filtered(spark, sf_dir), _PIVOTED)


@_query("""SELECT barcode, place // 32 AS block, sum(1::BIGINT << (place % 32)::INTEGER)::BIGINT AS present FROM (SELECT DISTINCT barcode, chrom || '_' || pos AS snv FROM filtered)
    JOIN (SELECT snv, row_number() OVER (ORDER BY snv) - 1 AS place FROM (SELECT DISTINCT chrom || '_' || pos AS snv FROM filtered)) USING (snv) GROUP BY ALL""", once=("spot_snvs", "filtered"))
def snv_matrix_blocks(spark, sf_dir):
    return matrix.blocks(_filtered(spark, sf_dir))


@_query("SELECT barcode, count(*) AS n_snvs FROM filtered GROUP BY barcode", once=("spot_snvs",))
def matrix_row_sums(spark, sf_dir):
    return matrix.per_spot(_filtered(spark, sf_dir))


@_query("""SELECT chrom, pos, concat_ws(chr(9), chrom, pos, '.', ref, alt, CASE WHEN qual = floor(qual) THEN floor(qual)::BIGINT || '.0' ELSE qual::VARCHAR END, '.', 'DP=' || dp, 'GT', gt) AS line FROM calls""")
def vcf_lines(spark, sf_dir):
    rows = views.calls(spark, sf_dir).withColumns({"id": F.lit(None).cast("string"), "filter": F.lit("."), "info": F.concat(F.lit("DP="), F.col("dp").cast("string")), "format": F.lit("GT"), "sample": F.col("gt")})
    return sinks.vcf_lines(rows)


@_query("SELECT chrom, pos, ref, alt, 'DP=' || dp AS info, 'GT' AS format, gt AS sample FROM calls")
def vcf_read_back(spark, sf_dir):
    path = new_path(spark, "vcf")
    sinks.write_vcf(views.calls(spark, sf_dir).withColumns({"info": F.concat(F.lit("DP="), F.col("dp").cast("string")), "format": F.lit("GT"), "sample": F.col("gt")}), path)
    return readers.vcf(spark, path).select("chrom", "pos", "ref", "alt", "info", "format", "sample")


@_query("SELECT barcode, in_tissue, x, y FROM spots")
def positions_read_back(spark, sf_dir):
    path = new_path(spark, "positions")
    sinks.write_csv(views.spots(spark, sf_dir).select("barcode", "in_tissue", F.lit(0).alias("array_row"), F.lit(0).alias("array_col"), "x", "y"), path)
    return readers.positions(spark, path, header=True).select("barcode", "in_tissue", "x", "y")


@_query("SELECT barcode, chrom, pos FROM filtered", once=("spot_snvs",))
def spot_snvs_read_back(spark, sf_dir):
    path = new_path(spark, "spot-snvs")
    sinks.write_spot_snvs(_filtered(spark, sf_dir), path)
    return readers.spot_folders(spark, path).select("barcode", "chrom", "pos")


@_query("SELECT barcode FROM spots WHERE in_tissue = 1")
def barcodes_read_back(spark, sf_dir):
    path = new_path(spark, "barcodes")
    lines = F.when(F.col("in_tissue") == 1, F.concat("barcode", F.lit("\t1"))).otherwise("")  # blank lines are left out
    views.spots(spark, sf_dir).select(lines).write.option("compression", "gzip").text(path)
    return readers.barcode_list(spark, path)


@_query("SELECT read_id, barcode, start0 FROM intervals WHERE read_id % 60 >= 20 AND (start0 + 1) % 40 >= 13")
def reads_read_back(spark, sf_dir):
    path = new_path(spark, "reads")
    rows = views.interval_reads(spark, sf_dir).withColumns({"mapq": (F.col("read_id") % 60).cast("int"), "baseq": ((F.col("start0") + 1) % 40).cast("int")})
    rows.write.parquet(path)
    return readers.reads(spark, path, min_mapq=20, min_baseq=13).select("read_id", "barcode", "start0")


# Learning


@_query("""SELECT chrom, pos, ref, alt, pos::DOUBLE AS f_pos, dp::DOUBLE AS f_dp, 0.25::DOUBLE AS f_vdb, 0.5::DOUBLE AS f_mqb, 0.0::DOUBLE AS f_rpb, 0.0::DOUBLE AS f_qs, (dp - ad - (dp - ad) // 2)::DOUBLE AS f_i16_0, (ad // 2)::DOUBLE AS f_i16_3 FROM calls""")
def features(spark, sf_dir):
    rows = learning.features(views.calls(spark, sf_dir))
    return rows.select("chrom", "pos", "ref", "alt", "f_pos", "f_dp", "f_vdb", "f_mqb", "f_rpb", "f_qs", "f_i16_0", "f_i16_3")


_ZEROS = ", ".join(f"0.0::DOUBLE AS {c}" for c in ("f_rpb", "f_bqb", "f_sgb", "f_baf", "f_gq", "f_qs", "f_mqsb", "f_mq0f", *[f"f_i16_{i}" for i in range(4, 16)]))


@_query(f"""SELECT chrom, pos, ref, alt, pos::DOUBLE AS f_pos, dp::DOUBLE AS f_dp, 0.25::DOUBLE AS f_vdb, 0.5::DOUBLE AS f_mqb, {_ZEROS}, (dp - ad - (dp - ad) // 2)::DOUBLE AS f_i16_0, ((dp - ad) // 2)::DOUBLE AS f_i16_1,
    (ad - ad // 2)::DOUBLE AS f_i16_2, (ad // 2)::DOUBLE AS f_i16_3 FROM calls""")
def features_all(spark, sf_dir):
    """Every feature column."""
    return learning.features(views.calls(spark, sf_dir)).select("chrom", "pos", "ref", "alt", *learning.FEATURES)


@_query("SELECT chrom, pos, ref, alt, round(CASE WHEN pos % 9 = 0 THEN (SELECT sum(ad - ad // 2)::DOUBLE / count(*) FROM calls WHERE pos % 9 <> 0) ELSE ad - ad // 2 END, 9) AS i16_2 FROM calls", once=("calls",))
def features_imputed(spark, sf_dir):
    calls = views.calls(spark, sf_dir).withColumn("info", F.when(F.col("pos") % 9 == 0, F.concat(F.lit("DP="), F.col("dp").cast("string"))).otherwise(F.col("info")))
    return learning.filled_with_mean(learning.features(calls)).select("chrom", "pos", "ref", "alt", F.round("f_i16_2", 9).alias("i16_2"))


@_query("SELECT chrom, pos, ref, alt, round((dp - m) / s, 9) AS z_dp, 0.0::DOUBLE AS z_qs FROM calls, (SELECT avg(dp) AS m, stddev_pop(dp) AS s FROM calls)", once=("calls",))
def scaled_features(spark, sf_dir):
    rows = learning.scaled(learning.filled_with_zero(learning.features(views.calls(spark, sf_dir))))
    return rows.select("chrom", "pos", "ref", "alt", F.round("f_dp", 9).alias("z_dp"), F.col("f_qs").alias("z_qs"))


_LABELLED = """SELECT chrom, pos, ref, alt, CASE new_gt WHEN '1/1' THEN 'homozygous' WHEN '0/1' THEN 'heterozygous' ELSE 'no_variance' END AS label FROM transitions
    UNION ALL SELECT chrom, pos, ref, alt, 'no_variance' FROM judged WHERE status = 'error'"""


@views.shared
def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.training_sets(_changes(spark, sf_dir), _judged(spark, sf_dir).filter("status = 'error'"))


@_query(_LABELLED, once=("calls", "changes"))
def training_sets(spark, sf_dir):
    return _labelled(spark, sf_dir)


@_query(f"""SELECT label, count(*) AS n FROM ({_LABELLED}) GROUP BY label""", once=("calls", "changes"))
def training_sizes(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@_query(f"""SELECT label, (CASE WHEN total <= 500 THEN n WHEN label = 'no_variance' THEN least(n, 500 - coalesce(sum(CASE WHEN label <> 'no_variance' THEN 500 * n // total END) OVER (), 0)) ELSE 500 * n // total END)::BIGINT AS n_taken
    FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM ({_LABELLED}) GROUP BY label)""", once=("calls", "changes"))
def training_sample_sizes(spark, sf_dir):
    return learning.sampled(_labelled(spark, sf_dir), 500).groupBy("label").agg(F.count("*").alias("n_taken"))


@_query("""SELECT chrom, pos, ref, alt, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('_', chrom, pos, ref, alt)), chrom, pos) <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test
    FROM (SELECT chrom, pos, ref, alt, CASE new_gt WHEN '1/1' THEN 'homozygous' WHEN '0/1' THEN 'heterozygous' ELSE 'no_variance' END AS label FROM transitions)""", once=("calls",))
def stratified_split(spark, sf_dir):
    return learning.split(learning.training_sets(_changes(spark, sf_dir)))


def _guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a model: the original genotype's class."""
    rows = _changes(spark, sf_dir)
    return rows.select(learning.training_class(F.col("orig_gt"), F.col("new_gt")).alias("label"), F.when(F.col("orig_gt") == "1/1", "homozygous").when(F.col("depth") % 7 == 0, "no_variance").otherwise("heterozygous").alias("predicted"))


_GUESSED = """SELECT CASE new_gt WHEN '1/1' THEN 'homozygous' WHEN '0/1' THEN 'heterozygous' ELSE 'no_variance' END AS label,
    CASE WHEN orig_gt = '1/1' THEN 'homozygous' WHEN depth % 7 = 0 THEN 'no_variance' ELSE 'heterozygous' END AS predicted FROM transitions"""


@_query(f"SELECT label, predicted, count(*) AS n FROM ({_GUESSED}) GROUP BY ALL", once=("calls",))
def confusion(spark, sf_dir):
    return reports.confusion(_guessed(spark, sf_dir))


def _f1(where: str) -> str:
    return f"""(SELECT c AS class, count(*) FILTER (label = c AND predicted = c) AS hit, count(*) FILTER (label = c) AS support, count(*) FILTER (predicted = c) AS guessed
        FROM ({_GUESSED}), (SELECT unnest(['heterozygous', 'homozygous', 'no_variance']) AS c) {where} GROUP BY c)"""


@_query(f"SELECT class, coalesce(hit / nullif(guessed, 0), 0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * hit / nullif(guessed + support, 0), 0)::DOUBLE AS f1, support FROM {_f1('')}", once=("calls",))
def class_report(spark, sf_dir):
    return reports.class_report(reports.confusion(_guessed(spark, sf_dir)))


_VARIANT_LABELS = "WHERE label IN ('heterozygous', 'homozygous')"


@_query(f"SELECT avg(coalesce(2 * hit / nullif(guessed + support, 0), 0)) AS variant_f1 FROM {_f1(_VARIANT_LABELS)} WHERE class <> 'no_variance'", once=("calls",))
def variant_f1(spark, sf_dir):
    return reports.variant_f1(_guessed(spark, sf_dir))


@_query(None, once=("calls",))
def classifier_scores(spark, sf_dir):
    """Fit on four fifths of the labelled variants, classes and probabilities of the rest."""
    calls = learning.filled_with_zero(learning.features(views.calls(spark, sf_dir)))
    rows = learning.split(learning.training_sets(_changes(spark, sf_dir))).join(calls, ["chrom", "pos", "ref", "alt"])
    model = learning.train(learning.sampled(rows.filter("NOT is_test"), 20_000).select("chrom", "pos", "ref", "alt", "label", *learning.FEATURES), "forest")
    path = new_path(spark, "model")
    learning.save(model, path)
    return learning.confident(learning.classified(learning.load(path), rows.filter("is_test")), 0.4).select("chrom", "pos", "ref", "alt", "label", "predicted", "p_het", "p_hom", "p_novar")


def _tested(spark: SparkSession, sf_dir: str, kind: str, **settings) -> DataFrame:
    """Fit on four fifths of the labelled variants, keep and load the model, classes and probabilities of the rest."""
    calls = learning.filled_with_zero(learning.features(views.calls(spark, sf_dir)))
    rows = stored(learning.split(learning.training_sets(_changes(spark, sf_dir))).join(calls, ["chrom", "pos", "ref", "alt"]).select("chrom", "pos", "ref", "alt", "label", "is_test", *learning.FEATURES), "labelled")
    path = new_path(spark, "model")
    learning.save(learning.train(rows.filter("NOT is_test"), kind, **settings), path)
    return learning.classified(learning.load(path, kind), rows.filter("is_test")).select("chrom", "pos", "ref", "alt", "label", "predicted", "p_het", "p_hom", "p_novar")


@_query(None, once=("calls",))
def boosted_scores(spark, sf_dir):
    """Boosted trees on all features; tests compare them with a plain version."""
    return _tested(spark, sf_dir, "boosted", rounds=10)


@_query(None, once=("calls",))
def boosted_variant_f1(spark, sf_dir):
    return reports.variant_f1(boosted_scores(spark, sf_dir))


@_query(None, once=("calls",))
def kernel_scores(spark, sf_dir):
    """A Gaussian kernel with calibrated probabilities; tests compare it with a plain version."""
    return _tested(spark, sf_dir, "kernel")


# Sections, runs and streams


@_query("SELECT section, count(*) AS n FROM (SELECT CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS section FROM calls) GROUP BY section")
def section_union(spark, sf_dir):
    calls = views.calls(spark, sf_dir)
    return readers.sections({"even": calls.filter("pos % 2 = 0"), "odd": calls.filter("pos % 2 = 1")}).groupBy("section").agg(F.count("*").alias("n"))


@_query("SELECT avg(o_shippriority) AS mean_duration, sum(n)::BIGINT AS total_snps, count(*) FILTER (ok) AS n_completed, count(*) FILTER (NOT ok) AS n_failed FROM (SELECT chrom, count(*) AS n, sum(dp)::DOUBLE AS o_shippriority, count(*) % 2 = 0 AS ok FROM calls GROUP BY chrom)")
def run_metrics(spark, sf_dir):
    runs = views.calls(spark, sf_dir).groupBy("chrom").agg(F.sum("dp").cast("double").alias("duration"), F.count("*").alias("snp_count"))
    return reports.run_metrics(runs.withColumn("status", F.when(F.col("snp_count") % 2 == 0, "completed").otherwise("failed")))


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return streaming.windowed(views.table(spark, sf_dir, "events"))

