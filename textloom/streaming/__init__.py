"""The text functions on streams."""
