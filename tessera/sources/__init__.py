"""Readers, writers and persistence."""

from tessera.sources.io import (
    read_table, read_batch, single_row, write_table, write_stats, read_stats,
    bounds_to_json, bounds_from_json, save_model, load_pipeline,
)

__all__ = ["read_table", "read_batch", "single_row", "write_table", "write_stats", "read_stats",
           "bounds_to_json", "bounds_from_json", "save_model", "load_pipeline"]
