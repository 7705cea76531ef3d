"""Part of vectide: sources."""
