"""Shared plan fragments: per-card roll-ups, ordered panels, exact ranks and samples."""
