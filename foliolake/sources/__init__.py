"""sources of foliolake."""
