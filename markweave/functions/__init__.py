"""Part of markweave."""
