"""Documents as JSON, HTML and text."""
