"""Options and the helpers that shape plans."""
