"""DataFrame-to-DataFrame operators; every relation is keyed by model_id."""
