"""Sources of moltable."""
