"""Part of vectide: streaming."""
