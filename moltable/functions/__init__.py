"""Functions of moltable."""
