"""DataFrame-to-DataFrame operators over readings."""
