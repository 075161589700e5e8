"""Stream specifications, scans and pipelines."""
