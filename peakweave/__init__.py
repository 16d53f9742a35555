"""Spark-native co-accessibility networks: regions, range windows, sparse inverse covariance, links and modules."""

from .kernels.glasso import QuicGraphicalLasso, quic
from .plans.api import (
    Atac,
    add_ccans,
    add_region_infos,
    compute_atac_network,
    compute_metacells,
    extract_atac_links,
    find_ccans,
    metacells,
    plot_ccan,
    plot_connections,
    plot_connections_genes,
    plot_genes,
    sliding_graphical_lasso,
    sort_regions,
    subset_region,
)

__all__ = [
    "Atac", "QuicGraphicalLasso", "add_ccans", "add_region_infos", "compute_atac_network", "compute_metacells", "extract_atac_links", "find_ccans",
    "metacells", "plot_ccan", "plot_connections", "plot_connections_genes", "plot_genes", "quic", "sliding_graphical_lasso", "sort_regions", "subset_region",
]
