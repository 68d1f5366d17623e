"""corvid.functions."""
