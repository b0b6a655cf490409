"""Versioned tables, row validation, writes, backup and change logs."""
