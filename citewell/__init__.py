"""Source-backed knowledge retrieval as Spark programs."""
