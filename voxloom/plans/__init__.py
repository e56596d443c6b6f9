"""Plan-level helpers: lineage cuts and bounded lookups."""
