"""DataFrame operators: regions, range windows, moments, links, modules, metacells and plot tables."""
