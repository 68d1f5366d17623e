"""corvid.plans."""
