"""Readers of tables, trees, manifests and logs."""
