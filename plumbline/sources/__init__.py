"""Input adapters."""
