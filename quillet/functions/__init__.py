"""Part of quillet; see README.md."""
