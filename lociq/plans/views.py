"""Variant data derived from the relational tables: one line item stands for one read of a spot at a site.

The likelihoods are a plain integer model of allele depth, not that of any caller. Every embedding is a spot and every site
a target. Spots lie on slides of SLIDE spots side by side, so that a spot has as many others around it at every scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import genotype
from lociq.scratch import stored

RADIUS2, SLIDE = 0.06, 500
CALL_LIMITS = {"min_depth": 0, "min_gq": 8, "min_qual": 0.0}


View = Callable[[SparkSession, str], DataFrame]
_ONCE: ContextVar[tuple[frozenset[str], dict[str, DataFrame]]] = ContextVar("once", default=(frozenset(), {}))


@contextmanager
def once(*names: str) -> Iterator[None]:
    """Inside, each of the named views is written when it is first asked for, and read wherever it is asked for again: for a query
    that uses it in several places."""
    token = _ONCE.set((frozenset(names), {}))
    try:
        yield
    finally:
        _ONCE.reset(token)


def shared(view: View) -> View:
    """A view that :func:`once` knows by its name."""

    @wraps(view)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = view.__name__.lstrip("_")
        names, held = _ONCE.get()
        if name not in names:
            return view(spark, sf_dir)
        if name not in held:
            held[name] = stored(view(spark, sf_dir), name)
        return held[name]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letter(place: Column) -> Column:
    return F.substring(F.lit("ACGT"), place.cast("int"), F.lit(1))


def _site_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, ref, alt, is_alt, the read's id and length, and the customer that stands for its spot."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return joined.select(
        "o_custkey", F.concat(F.lit("chr"), (part % 22 + 1).cast("string")).alias("chrom"), part.cast("int").alias("pos"),
        _letter(part % 4 + 1).alias("ref"), _letter((part + 1 + supp % 3) % 4 + 1).alias("alt"), (F.col("l_returnflag") == "R").alias("is_alt"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.col("l_quantity").cast("int").alias("length"),
    )


@shared
def site_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with their barcode: customers over the whole range of spots, whose number is one row."""
    n_spots = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n_spots"))
    return _site_items(spark, sf_dir).join(F.broadcast(n_spots)).withColumn("barcode", F.concat(F.lit("s"), (F.col("o_custkey") % F.col("n_spots")).cast("string"))).drop("o_custkey", "n_spots")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a caller would write them: depth and I16 in INFO, likelihoods in the sample."""
    sites = _site_items(spark, sf_dir).groupBy("chrom", "pos", "ref", "alt").agg(F.count_if("is_alt").alias("ad"), F.count("*").alias("dp"))
    ref, alt = F.col("dp") - F.col("ad"), F.col("ad")
    half = lambda c: F.floor(c / 2)
    counts = F.concat_ws(",", *[c.cast("string") for c in (ref - half(ref), half(ref), alt - half(alt), half(alt))], F.lit("0,0,0,0,0,0,0,0,0,0,0,0"))
    info = F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";I16="), counts, F.lit(";MQB=0.5;VDB=0.25"))
    sample = F.concat_ws(",", *[c.cast("string") for c in (10 * alt, 3 * F.col("dp"), 10 * ref)])
    return sites.select("chrom", "pos", F.lit(".").alias("id"), "ref", "alt", (F.col("ad") * 7.5).cast("string").alias("qual"), F.lit(".").alias("filter"), info.alias("info"), F.lit("PL").alias("format"), sample.alias("sample"))


@shared
def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotype.called(variants(spark, sf_dir), **CALL_LIMITS)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the called variants are known."""
    return calls(spark, sf_dir).filter("pos % 3 <> 0")


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls with genotypes as a phasing step might change them; ``ord`` is the order of the lines."""
    new = F.when(F.col("pos") % 5 == 0, "0/0").when(F.col("pos") % 5 == 1, "1/1").when(F.col("pos") % 5 == 2, "0/1").otherwise(F.col("gt"))
    return calls(spark, sf_dir).withColumn("gt", new).withColumn("ord", F.concat("ref", "alt"))


@shared
def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return rows.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("barcode"), F.when(F.col("vec_id") % 50 == 49, 0).otherwise(1).alias("in_tissue"), (at(0) + 4.0 * F.floor(F.col("vec_id") / SLIDE)).alias("x"), at(1).alias("y"))


@shared
def spot_snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (barcode, chrom, pos) of reads whose site is called; bare chromosomes."""
    found = site_reads(spark, sf_dir).join(calls(spark, sf_dir).select("chrom", "pos", "ref", "alt"), ["chrom", "pos", "ref", "alt"], "left_semi")
    return found.select("barcode", F.regexp_replace("chrom", "chr", "").alias("chrom"), "pos").distinct()


def interval_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one chromosome as intervals, some unmapped or without an end."""
    rows = site_reads(spark, sf_dir)
    start = F.col("pos") - 1
    end = F.when(F.col("read_id") % 41 != 0, start + F.col("length"))
    return rows.select("read_id", "barcode", F.lit("chr1").alias("chrom"), start.alias("start0"), end.alias("end0"), (F.col("read_id") % 37 == 0).alias("unmapped"))


@shared
def target_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants at all positions, several at some; ``ord`` is the order of the lines."""
    rows = _site_items(spark, sf_dir).select(F.lit("1").alias("chrom"), "pos", "ref", "alt").distinct()
    return rows.withColumn("ord", F.concat("ref", "alt"))


#: The same views in SQL, as common table expressions.
SQL = """
reads AS (SELECT 's' || (o_custkey % (SELECT max(vec_id) + 1 FROM embeddings)) AS barcode, 'chr' || (l_partkey % 22 + 1) AS chrom, l_partkey::INTEGER AS pos, substr('ACGT', (l_partkey % 4 + 1)::INTEGER, 1) AS ref,
    substr('ACGT', ((l_partkey + 1 + l_suppkey % 3) % 4 + 1)::INTEGER, 1) AS alt, l_returnflag = 'R' AS is_alt, l_orderkey * 10 + l_linenumber AS read_id, l_quantity::INTEGER AS length
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sites AS (SELECT chrom, pos, ref, alt, count(*) FILTER (is_alt) AS ad, count(*) AS dp FROM reads GROUP BY ALL),
likely AS (SELECT *, 10 * ad AS p0, 3 * dp AS p1, 10 * (dp - ad) AS p2, ad * 7.5 AS qual FROM sites),
genotyped AS (SELECT *, CASE WHEN p0 <= p1 AND p0 <= p2 THEN '0/0' WHEN p1 <= p2 THEN '0/1' ELSE '1/1' END AS gt, (list_sort([p0, p1, p2])[2] - list_sort([p0, p1, p2])[1])::INTEGER AS gq,
    ad::DOUBLE / dp AS baf FROM likely),
calls AS (SELECT chrom, pos, ref, alt, gt, gq, baf, dp::INTEGER AS dp, qual::DOUBLE AS qual, ad FROM genotyped WHERE gt <> '0/0'),
panel AS (SELECT * FROM calls WHERE pos % 3 <> 0),
phased AS (SELECT * REPLACE (CASE pos % 5 WHEN 0 THEN '0/0' WHEN 1 THEN '1/1' WHEN 2 THEN '0/1' ELSE gt END AS gt), ref || alt AS ord FROM calls),
transitions AS (SELECT o.chrom, o.pos, o.ref, o.alt, o.gt AS orig_gt, p.gt AS new_gt, o.baf, o.dp AS depth FROM calls o
    JOIN (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY ord DESC) AS place FROM phased) p ON o.chrom = p.chrom AND o.pos = p.pos AND o.ref = p.ref AND o.alt = p.alt AND p.place = 1),
learned AS (SELECT ref, alt, orig_gt, CASE orig_gt WHEN '0/1' THEN median(baf) ELSE 0.99 END::DOUBLE AS baf_thr, median(depth)::DOUBLE AS depth_thr, count(*) AS n
    FROM transitions WHERE new_gt = '0/0' AND orig_gt IN ('0/1', '1/1') GROUP BY ref, alt, orig_gt),
judged AS (SELECT c.chrom, c.pos, c.ref, c.alt, c.gt, CASE WHEN c.gt = '0/0' THEN 'hom_ref' WHEN c.gt IS NULL OR c.baf IS NULL OR c.dp IS NULL THEN 'missing'
    WHEN coalesce(c.baf <= baf_thr AND c.dp <= depth_thr, false) THEN 'error' ELSE 'no_error' END AS status FROM calls c LEFT JOIN learned l ON c.ref = l.ref AND c.alt = l.alt AND c.gt = l.orig_gt),
spots AS (SELECT 's' || vec_id AS barcode, CASE WHEN vec_id % 50 = 49 THEN 0 ELSE 1 END AS in_tissue, embedding[1]::DOUBLE + 4.0::DOUBLE * (vec_id // 500) AS x, embedding[2]::DOUBLE AS y FROM embeddings),
edges AS (SELECT src, dst, dist2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist2, dst) AS place FROM (SELECT a.barcode AS src, b.barcode AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS dist2
    FROM spots a JOIN spots b ON a.barcode <> b.barcode) WHERE dist2 <= sqrt(0.06::DOUBLE) * sqrt(0.06::DOUBLE)) WHERE place <= 12),
spot_snvs AS (SELECT DISTINCT barcode, replace(chrom, 'chr', '') AS chrom, pos FROM reads WHERE (chrom, pos, ref, alt) IN (SELECT (chrom, pos, ref, alt) FROM calls)),
supports AS (SELECT s.barcode, s.chrom, s.pos, count(n.barcode) AS support FROM spot_snvs s LEFT JOIN edges e ON e.src = s.barcode
    LEFT JOIN spot_snvs n ON n.barcode = e.dst AND n.chrom = s.chrom AND n.pos = s.pos GROUP BY ALL),
filtered AS (SELECT barcode, chrom, pos FROM supports WHERE support >= 2 AND barcode IN (SELECT barcode FROM spots)),
intervals AS (SELECT read_id, barcode, 'chr1' AS chrom, pos - 1 AS start0, CASE WHEN read_id % 41 <> 0 THEN pos - 1 + length END AS end0, read_id % 37 = 0 AS unmapped FROM reads),
targets AS (SELECT DISTINCT '1' AS chrom, pos, ref, alt, ref || alt AS ord FROM reads),
hits AS (SELECT i.read_id, i.barcode, min(t.pos) AS pos FROM intervals i JOIN (SELECT DISTINCT pos FROM targets) t ON t.pos BETWEEN i.start0 + 1 AND coalesce(i.end0 + 1, i.start0 + 1)
    WHERE NOT i.unmapped GROUP BY i.read_id, i.barcode),
detected AS (SELECT DISTINCT h.barcode, '1' AS chrom, h.pos, a.ref, a.alt FROM hits h JOIN (SELECT pos, max_by(ref, ord) AS ref, max_by(alt, ord) AS alt FROM targets GROUP BY pos) a ON a.pos = h.pos),
counted AS (SELECT s.barcode, coalesce(b.n, 0)::BIGINT AS n_before, coalesce(a.n, 0)::BIGINT AS n_after FROM spots s
    LEFT JOIN (SELECT barcode, count(*) AS n FROM spot_snvs GROUP BY barcode) b ON b.barcode = s.barcode LEFT JOIN (SELECT barcode, count(*) AS n FROM filtered GROUP BY barcode) a ON a.barcode = s.barcode)
"""
