"""Readers that bring raw data into the readings layout."""
