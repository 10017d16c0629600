"""Sources and sinks: block tables on disk, and a data source whose filters prune blocks by their search tables."""
