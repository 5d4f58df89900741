"""functions of foliolake."""
