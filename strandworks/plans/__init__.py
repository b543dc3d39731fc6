"""Plan helpers: staged tables that cut lineage, and table access."""
