"""Part of vectide: functions."""
