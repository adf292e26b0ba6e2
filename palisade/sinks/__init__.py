"""Writers: upserts, result tables, splits, model registry, retention."""
