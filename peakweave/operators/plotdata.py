"""Tables behind plots: arcs of links, region boxes, gene tracks, one module's window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .regions import name_parts, require_columns

#: Colours of the strands and of the sign of a score.
PLUS, MINUS = "#00A08A", "#F2AD00"


def _place(name: str, k: int, sep: tuple[str, str]) -> Column:
    return name_parts(F.col(name), sep).getItem(k)


def connections_in(links: DataFrame, chromosome: str, start: int, end: int, sep: tuple[str, str] = ("_", "_"), check: bool = True) -> DataFrame:
    """Links whose first region ends and whose second region starts in [start, end], with their coordinates."""
    require_columns(links, ["Peak1", "Peak2", "score"], ValueError)
    number = lambda n, k: _place(n, k, sep).cast("bigint")
    own = links.where((_place("Peak1", 0, sep) == chromosome) & (_place("Peak2", 0, sep) == chromosome))
    placed = own.withColumns({"start1": number("Peak1", 1), "end1": number("Peak1", 2), "start2": number("Peak2", 1), "end2": number("Peak2", 2)})
    found = placed.where(F.col("end1").between(start, end) & F.col("start2").between(start, end))
    if check and not found.limit(1).count():
        raise ValueError(f"no connections in {chromosome}:{start}-{end}")
    return found


def arcs(found: DataFrame, abs_threshold: float = 0.4, only_positive: bool = False) -> DataFrame:
    """Geometry of the links' arcs; scaled by the largest score in the window, those under the threshold left out."""
    score = F.col("score")
    found = checkpointed(found)  # links may be long to find, and are few here
    top = found.agg(F.max(F.abs("score"))).first()[0] or 1.0
    shown = found.where((score if only_positive else F.abs(score)) >= abs_threshold).where(score != 0)
    mid1, mid2 = (F.col("start1") + F.col("end1")) / 2, (F.col("start2") + F.col("end2")) / 2
    return shown.select(
        "Peak1", "Peak2", "score", ((mid1 + mid2) / 2).alias("center"), (mid2 - mid1).alias("width"), (2 * F.abs(score)).alias("height"),
        (F.abs(score) / F.lit(top)).alias("alpha"), (4 * F.abs(score) / F.lit(top)).alias("line_width"), F.when(score > 0, "positive").otherwise("negative").alias("sign"),
    )


def arc_regions(found: DataFrame) -> DataFrame:
    """(start, end) of the regions at either end, each once."""
    return found.select(F.col("start1").alias("start"), F.col("end1").alias("end")).union(found.select("start2", "end2")).distinct()


def normalize_genes(raw: DataFrame) -> DataFrame:
    """Genes from an annotation table: chromosome_name, start_position, end_position, strand (1 or -1), external_gene_name."""
    strand = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-")
    return raw.select(
        F.concat(F.lit("chr"), F.col("chromosome_name").cast("string")).alias("chromosome"), F.col("start_position").alias("start"), F.col("end_position").alias("end"),
        strand.alias("strand"), F.col("external_gene_name").alias("genename"),
    )


def genes_in(genes: DataFrame, chromosome: str, start: int, end: int, check: bool = True) -> DataFrame:
    """Genes that lie within [start, end]."""
    require_columns(genes, ["chromosome", "start", "end", "genename"], ValueError)
    own = genes.where(F.col("chromosome") == chromosome)
    if check and not own.limit(1).count():
        raise ValueError(f"no genes on {chromosome}")
    found = own.where((F.col("start") >= start) & (F.col("end") <= end))
    if check and not found.limit(1).count():
        raise ValueError(f"no genes in {chromosome}:{start}-{end}")
    return found.withColumn("genename", F.coalesce("genename", F.lit("unknown")))


def gene_labels(genes: DataFrame, fontsize: float = 10, name_padding: float = 0.5) -> DataFrame:
    """Width of the label and its padding, and the strand's colour."""
    width = F.length("genename") * (fontsize * 0.15)
    return genes.withColumns({"name_width": width, "padding": width + name_padding * fontsize, "color": F.when(F.col("strand") == "+", PLUS).otherwise(MINUS)})


def gene_tracks(genes: DataFrame, gene_spacing: float = 100_000, fontsize: float = 10, name_padding: float = 0.5) -> DataFrame:
    """Genes with the first track that has room for gene and label; a chromosome is packed in one group, in order of start."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start", "end", "genename"])
        tracks: list[list[tuple]] = []
        place = []
        for g in part.itertuples():
            for k, track in enumerate(tracks):
                if all(e + pad + name_padding <= g.start - gene_spacing or s >= g.end + gene_spacing + g.padding for s, e, pad in track):
                    break
            else:
                k = len(tracks)
                tracks.append([])
            tracks[k].append((g.start, g.end, g.padding))
            place.append(k)
        return part[["chromosome", "genename", "start", "end"]].assign(track=place)

    labelled = gene_labels(genes, fontsize, name_padding).select("chromosome", "genename", "start", "end", "padding")
    return labelled.groupBy("chromosome").applyInPandas(pack, "chromosome string, genename string, start bigint, end bigint, track bigint")


def module_window(regions: DataFrame, module: object, ccan_col: str = "CCAN", check: bool = True) -> DataFrame:
    """(chromosome, start, end) of a module, one percent wider on either side; ValueError without regions or across chromosomes."""
    own = regions.where(F.col(ccan_col) == module).agg(F.min("chromosome").alias("chromosome"), F.max("chromosome").alias("last"), F.min("start").alias("a"), F.max("end").alias("b"))
    if check:
        r = own.first()
        if r.a is None:
            raise ValueError(f"no regions in module {module}")
        if r.chromosome != r.last:
            raise ValueError(f"module {module} has regions on several chromosomes")
    margin = (F.col("b") - F.col("a")) * 0.01
    return own.select("chromosome", (F.col("a") - margin).alias("start"), (F.col("b") + margin).alias("end"))


def mask_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links with score 0 where an end is outside the members (peak)."""
    one = lambda c: members.select(F.col("peak").alias(c)).distinct().withColumn(f"has_{c}", F.lit(1))
    both = links.join(one("Peak1"), "Peak1", "left").join(one("Peak2"), "Peak2", "left")
    return both.withColumn("score", F.when(F.col("has_Peak1").isNull() | F.col("has_Peak2").isNull(), 0.0).otherwise(F.col("score"))).drop("has_Peak1", "has_Peak2")
