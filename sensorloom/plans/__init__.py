"""Ready-made daily reports."""
