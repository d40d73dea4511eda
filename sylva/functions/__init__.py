"""Part of the sylva analytics engine."""
