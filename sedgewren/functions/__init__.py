"""Part of sedgewren."""
