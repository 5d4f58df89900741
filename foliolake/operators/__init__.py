"""operators of foliolake."""
