"""Part of vectide: operators."""
