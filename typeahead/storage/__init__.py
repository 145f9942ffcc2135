"""Versioned storage: manifests, transactions, compaction, cleanup, leases."""
