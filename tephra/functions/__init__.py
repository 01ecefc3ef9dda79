"""Part of the tephra engine."""
