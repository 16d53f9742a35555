"""The public functions, over a small holder of tables."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import graph, links, metacells as cells, network as net, plotdata, regions as reg
from ..sources.tables import choose_key


@dataclass
class Atac:
    """Counts and what is derived from them."""

    counts: DataFrame
    regions: DataFrame
    n_cells: int
    networks: dict[str, DataFrame] = field(default_factory=dict)
    embeddings: dict[str, DataFrame] = field(default_factory=dict)


def add_region_infos(atac: Atac, sep: tuple[str, str] = ("_", "_")) -> Atac:
    """Regions with coordinates in order; counts and networks follow the new numbers."""
    old = atac.regions
    new = reg.add_region_infos(old.select("peak"), sep=sep)
    if "idx" not in old.columns:
        return Atac(atac.counts, new, atac.n_cells, atac.networks, atac.embeddings)
    by = old.select("peak", "idx").join(new.select("peak", new["idx"].alias("new")), "peak").select("idx", "new")
    counts = atac.counts.join(by, "idx").drop("idx").withColumnRenamed("new", "idx")
    return Atac(counts, new, atac.n_cells, {}, atac.embeddings)


def sort_regions(atac: Atac) -> Atac:
    return Atac(atac.counts, reg.sort_regions(atac.regions.drop("idx")), atac.n_cells, {}, atac.embeddings)


def subset_region(atac: Atac, chromosome: str, start: int, end: int) -> Atac:
    """Regions with an end in the range, with their counts and links."""
    kept = reg.subset_region(atac.regions, chromosome, start, end)
    networks = {k: reg.subset_network(v, kept) for k, v in atac.networks.items()}
    return Atac(reg.subset_counts(atac.counts, kept), kept, atac.n_cells, networks, atac.embeddings)


def sliding_graphical_lasso(atac: Atac, **parameters) -> DataFrame:
    return net.sliding_graphical_lasso(atac.counts, atac.regions, atac.n_cells, **parameters)


def compute_atac_network(atac: Atac, key: str = "atac_network", **parameters) -> None:
    """Infer the network and keep it under ``key``."""
    atac.networks[key] = net.settled(sliding_graphical_lasso(atac, **parameters))


def extract_atac_links(atac: Atac, key: str | None = None, columns: tuple[str, str, str] = ("Peak1", "Peak2", "score")) -> DataFrame:
    """Named links, the largest scores first."""
    own = links.extract_links(atac.networks[choose_key(sorted(atac.networks), key)], atac.regions, columns[:2])
    return links.order_links(own).withColumnRenamed("score", columns[2])


def find_ccans(connections: DataFrame, **parameters) -> DataFrame:
    return graph.find_ccans(connections, **parameters)


def add_ccans(atac: Atac, key: str | None = None, ccan_col: str = "CCAN", **parameters) -> Atac:
    """Regions with their modules."""
    found = graph.find_ccans(extract_atac_links(atac, key), **parameters)
    return Atac(atac.counts, graph.add_ccans(atac.regions, found, ccan_col), atac.n_cells, atac.networks, atac.embeddings)


def compute_metacells(atac: Atac, k: int = 50, max_overlap_metacells: float = 0.9, max_metacells: int | None = None, dim_reduction: str = "lsi", projection: str | None = None, method: str = "mean", metric: str = "cosine") -> Atac:
    """Metacells in the place of cells.  ``metric`` has no effect and is kept for callers that pass it."""
    del metric
    own = atac.embeddings.get(dim_reduction)
    values = cells.compute_metacells(atac.counts, atac.regions, atac.n_cells, k, max_overlap_metacells, max_metacells, dim_reduction, projection, method, own)
    values = graph.checkpointed(values)
    return Atac(values, atac.regions, values.select("cell").distinct().count(), atac.networks)


def _renamed(table: DataFrame, names: dict[str, str | None]) -> DataFrame:
    """The table with the caller's columns under our names; ValueError if one is missing."""
    own = {ours: given or ours for ours, given in names.items()}
    reg.require_columns(table, list(own.values()), ValueError)
    return table.select(*[table[given].alias(ours) for ours, given in own.items()])


def plot_connections(
    connections: DataFrame | Atac, chromosome: str, start: int, end: int, abs_threshold: float = 0.4, only_positive: bool = False, sep: tuple[str, str] = ("_", "_"),
    key: str | None = None, peak1_col: str | None = None, peak2_col: str | None = None, score_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(arcs, regions) of the links in a range; a table of links may have its columns under other names."""
    names = {"Peak1": peak1_col, "Peak2": peak2_col, "score": score_col}
    if isinstance(connections, Atac):
        if any(names.values()):
            warnings.warn("peak1_col, peak2_col and score_col are ignored for an Atac", UserWarning, stacklevel=2)
        connections = extract_atac_links(connections, key)
    elif not isinstance(connections, DataFrame):
        raise ValueError("connections must be a DataFrame of links or an Atac")
    else:
        if key is not None:
            warnings.warn("key is ignored for a table of links", UserWarning, stacklevel=2)
        connections = _renamed(connections, names)
    found = plotdata.connections_in(connections, chromosome, start, end, sep)
    return plotdata.arcs(found, abs_threshold, only_positive), plotdata.arc_regions(found)


def plot_genes(
    genes: DataFrame, chromosome: str, start: int, end: int, gene_spacing: float = 100_000, fontsize: float = 10, name_padding: float = 0.5,
    chromosome_col: str | None = None, start_col: str | None = None, end_col: str | None = None, name_col: str | None = None, strand_col: str | None = None,
) -> DataFrame:
    """Genes in a range with their tracks; the table may have its columns under other names."""
    own = _renamed(genes, {"chromosome": chromosome_col, "start": start_col, "end": end_col, "genename": name_col, "strand": strand_col})
    return plotdata.gene_tracks(plotdata.genes_in(own, chromosome, start, end), gene_spacing, fontsize, name_padding)


def plot_connections_genes(connections: DataFrame | Atac, genes: DataFrame, chromosome: str, start: int, end: int, gene_spacing: float = 100_000, **parameters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, regions, genes)."""
    return (*plot_connections(connections, chromosome, start, end, **parameters), plot_genes(genes, chromosome, start, end, gene_spacing))


def plot_ccan(atac: Atac, ccan_module: object, ccan_col: str = "CCAN", varp: str | None = "atac_network", **parameters) -> tuple[DataFrame, DataFrame]:
    """(arcs, regions) of a module's range; links that leave the module have score 0."""
    reg.require_columns(atac.regions, [ccan_col], ValueError)
    at = plotdata.module_window(atac.regions, ccan_module, ccan_col).first()
    own = subset_region(atac, at.chromosome, int(at.start), int(at.end))
    members = atac.regions.where(atac.regions[ccan_col] == ccan_module).select("peak")
    masked = plotdata.mask_links(extract_atac_links(own, varp), members)
    return plot_connections(masked, at.chromosome, int(at.start), int(at.end), **parameters)


metacells = cells
