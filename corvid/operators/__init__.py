"""corvid.operators."""
