"""Left alignment of variants against a reference sequence that is kept in overlapping tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.scratch import stored

TILE, FLANK = 512, 128  # bases of a tile, and of the stretch before and after it that the tile repeats


def tiles(reference: DataFrame, tile: int = TILE, flank: int = FLANK) -> DataFrame:
    """(chrom, tile, first, bases) from stretches of a sequence (chrom, start from 1, seq) of any length that don't overlap.

    Tile i holds the bases i * tile + 1 to (i + 1) * tile and ``flank`` more on either side, as far as there are any; ``first`` is the
    position of its first base. A stretch is cut where it lies and only pieces are sent. Bases are in capitals; a gap
    between stretches, like a base that is not A, C, G or T, is N.
    """
    last = F.col("start") + F.length("seq") - 1
    at = F.sequence(F.greatest(F.floor((F.col("start") - 1 - flank) / tile), F.lit(0)), F.floor((last - 1 + flank) / tile))
    rows = reference.filter(F.length("seq") > 0).select("chrom", F.col("start").cast("long").alias("start"), F.upper("seq").alias("seq"), last.alias("last"), F.explode(at).alias("tile"))
    low, high = F.greatest(F.col("start"), F.col("tile") * tile + 1 - flank), F.least(F.col("last"), (F.col("tile") + 1) * tile + flank)
    cut = rows.withColumn("low", low).select("chrom", "tile", "low", F.substring("seq", (F.col("low") - F.col("start") + 1).cast("int"), (high - F.col("low") + 1).cast("int")).alias("part")).filter(F.length("part") > 0)
    whole = cut.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("parts"))  # a tile's pieces: as many as it has bases at most
    first = F.get("parts", 0)["low"]

    def put(done: Column, piece: Column) -> Column:
        return F.concat(F.rpad(done, (piece["low"] - F.get("parts", 0)["low"]).cast("int"), F.lit("N")), piece["part"])

    bases = F.aggregate("parts", F.lit(""), put)
    return whole.select("chrom", "tile", first.alias("first"), F.regexp_replace(bases, "[^ACGT]", "N").alias("bases"))


def _shared(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike."""
    n = F.least(F.length(a), F.length(b))
    unlike = F.array_position(F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x == y), False)
    return F.when(n == 0, 0).when(unlike == 0, n).otherwise(unlike - 1).cast("int")


def _trimmed(rows: DataFrame) -> DataFrame:
    """Adds __pos, __r and __a: what is left of the alleles without what they end and then begin with alike."""
    upper = rows.withColumns({"__r": F.upper("ref"), "__a": F.upper("alt")})
    tail = upper.withColumn("__n", _shared(F.reverse("__r"), F.reverse("__a")))
    cut = lambda c, n: F.left(F.col(c), F.length(c) - n)
    head = tail.withColumns({"__r": cut("__r", F.col("__n")), "__a": cut("__a", F.col("__n"))}).withColumn("__n", _shared(F.col("__r"), F.col("__a")))
    rest = lambda c: F.right(F.col(c), F.length(c) - F.col("__n"))
    return head.withColumns({"__pos": F.col("pos").cast("long") + F.col("__n"), "__r": rest("__r"), "__a": rest("__a")}).drop("__n")


def left_aligned(variants: DataFrame, tiled: DataFrame, tile: int = TILE, flank: int = FLANK) -> DataFrame:
    """``variants`` (chrom, pos, ref, alt and others; one alternative allele a row) with pos, ref and alt in the leftmost of the forms that
    mean the same, and ``aligned``.

    Alleles are trimmed. What remains of an insertion or a deletion is moved left while the base before it equals its last one: as many
    places as the sequence before it, and that with the inserted or deleted bases behind, end alike. This is
    taken from the flank of one tile; only variants that pass over a whole flank meet another one, written in between. The base
    before it is put in front (at the first base of a chromosome, the one after it behind).

    ``aligned`` is false, and the row as it was, if the reference has other bases than ref, or none there, or an allele is no text of A, C, G, T
    (symbolic, null, several). Alleles that differ otherwise than by an insertion or deletion are trimmed only, to at least a
    base each; equal alleles stay. Repeated rows count each; chromosomes must be named alike in both.
    """
    own = variants.columns
    plain = F.coalesce(F.upper("ref").rlike("^[ACGT]+$") & F.upper("alt").rlike("^[ACGT]+$") & (F.upper("ref") != F.upper("alt")) & (F.col("pos") > 0), F.lit(False))
    row = F.struct(*own).alias("__row")
    rest = variants.filter(~plain).select(row, F.lit(None).cast("long").alias("__pos"), F.lit(None).cast("string").alias("__r"), F.lit(None).cast("string").alias("__a"), F.lit(False).alias("aligned"))
    todo = _trimmed(variants.filter(plain)).select(row, "chrom", "__pos", "__r", "__a", F.lit(True).alias("__fresh"))
    done = rest
    while True:
        place = F.floor((F.col("__pos") - 1) / tile)
        met = todo.withColumn("tile", place).join(tiled.select("chrom", "tile", "first", "bases"), ["chrom", "tile"], "left")
        offset = (F.col("__pos") - F.col("first")).cast("int")  # bases of the tile before the variant
        at = lambda p, n: F.substring("bases", (p - F.col("first") + 1).cast("int"), n)
        before = F.when(offset > 0, F.right(F.left("bases", offset), F.lit(flank))).otherwise("")
        inside = (F.col("__row.pos") >= F.col("first")) & (F.col("__row.pos") + F.length("__row.ref") <= F.col("first") + F.length("bases"))
        right = F.when(inside, at(F.col("__row.pos"), F.length("__row.ref")) == F.upper("__row.ref")).otherwise(F.when(F.col("__r") != "", at(F.col("__pos"), F.length("__r")) == F.left("__r", F.length("bases") - offset)).otherwise(offset <= F.length("bases")))
        met = met.withColumns({"before": before, "right": F.coalesce(~F.col("__fresh") | right, F.lit(False)), "after": F.coalesce(at(F.col("__pos") + F.length("__r"), F.lit(1)), F.lit(""))})
        moved = F.when((F.col("__r") == "") | (F.col("__a") == ""), F.concat("__r", "__a"))  # what is inserted or deleted
        met = met.withColumn("moved", moved).withColumn("k", F.coalesce(_shared(F.reverse("before"), F.reverse(F.concat("before", "moved"))), F.lit(0)))
        going = F.col("right") & (F.col("k") == F.length("before")) & (F.col("k") == flank)
        size = F.length("moved")
        turned = F.right(F.left(F.concat("before", "moved"), F.length("before") + size - F.col("k")), size)
        # The base that follows where it comes to stand: one that it passed over, or the one after it.
        passed = F.when(F.col("__r") == "", F.left("before", F.lit(1))).otherwise(F.substring(F.concat("before", "moved"), (size + 1).cast("int"), F.lit(1)))
        met = met.withColumns({"turned": turned, "__pos": F.col("__pos") - F.col("k"), "after": F.when(F.col("k") > 0, passed).otherwise(F.col("after"))})
        new_r, new_a = F.when(F.col("moved").isNull(), F.col("__r")).when(F.col("__r") == "", "").otherwise(F.col("turned")), F.when(F.col("moved").isNull(), F.col("__a")).when(F.col("__a") == "", "").otherwise(F.col("turned"))
        anchor = F.right(F.left("before", F.length("before") - F.col("k")), F.lit(1))
        met = stored(met.select("__row", "chrom", "__pos", new_r.alias("__r"), new_a.alias("__a"), going.alias("going"), "right", anchor.alias("anchor"), "after", F.col("moved").isNotNull().alias("is_moved")), "left-align")
        anchored = lambda c: F.when(F.col("is_moved"), F.concat("anchor", c, F.when(F.col("anchor") == "", F.col("after")).otherwise(""))).otherwise(F.col(c))
        ended = met.filter(~F.col("going"))
        done = done.unionByName(ended.select("__row", F.when(F.col("right"), F.col("__pos") - F.when(F.col("is_moved") & (F.col("anchor") != ""), 1).otherwise(0)).alias("__pos"), anchored("__r").alias("__r"), anchored("__a").alias("__a"), F.col("right").alias("aligned")))
        if not met.filter("going").take(1):
            break
        todo = met.filter("going").select("__row", "chrom", "__pos", "__r", "__a", F.lit(False).alias("__fresh"))
    changed = {"pos": F.col("__pos"), "ref": F.col("__r"), "alt": F.col("__a")}
    return done.select(*[F.when(F.col("aligned"), changed[c]).otherwise(F.col("__row")[c]).cast(variants.schema[c].dataType).alias(c) if c in changed else F.col("__row")[c].alias(c) for c in own], "aligned")
