"""Plan helpers: range joins, islands, deduplicated UDF calls."""
