"""Change sets, the streaming ingestor and replicas."""
