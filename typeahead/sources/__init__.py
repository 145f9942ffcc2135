"""Document sources and corpus preparation."""
