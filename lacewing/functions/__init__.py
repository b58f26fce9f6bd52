"""Part of the graph-collection engine; see the README."""
