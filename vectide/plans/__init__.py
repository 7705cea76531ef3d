"""Part of vectide: plans."""
