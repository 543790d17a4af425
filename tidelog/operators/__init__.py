"""Reads, folds, compaction, statistics and replication analytics over op logs."""
