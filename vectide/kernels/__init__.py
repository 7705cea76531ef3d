"""Part of vectide: kernels."""
