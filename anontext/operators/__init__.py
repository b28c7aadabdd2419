"""DataFrame-to-DataFrame operators used by the plans."""
