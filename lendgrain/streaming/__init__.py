"""Statement signals over streams of transactions."""
