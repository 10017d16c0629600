"""Plans: which blocks a search has to read."""
