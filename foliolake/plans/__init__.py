"""plans of foliolake."""
