"""Plans of moltable."""
