"""Named queries over the driver tables."""
