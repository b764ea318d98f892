"""The query catalogue: adapters over the shared tables, Spark plans and their SQL equivalents."""
