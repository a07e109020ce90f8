"""Part of meshlake."""
