"""streaming of foliolake."""
