"""Column-level building blocks: pure expressions, no shuffles, no Python workers."""
