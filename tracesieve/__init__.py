"""Session-trace hygiene on Spark: redact, review, scan, publish and flatten agent traces."""
