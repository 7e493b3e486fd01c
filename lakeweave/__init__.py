"""Lake-table discovery and schema matching as Spark jobs."""
