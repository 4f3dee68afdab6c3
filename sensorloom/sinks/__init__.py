"""Writers for operator results."""
