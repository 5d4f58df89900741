"""foliolake: document-structure analytics expressed as DataFrame operations."""

__version__ = "0.1.0"
