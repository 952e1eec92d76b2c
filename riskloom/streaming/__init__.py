"""The batch operators that also make sense on streams."""
