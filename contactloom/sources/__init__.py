"""Where seeds and pages come from."""
