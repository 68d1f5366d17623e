"""corvid.streaming."""
