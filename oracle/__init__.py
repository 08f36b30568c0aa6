"""DuckDB statements that restate the registered queries, used only for checking."""
