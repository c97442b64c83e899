"""Named queries over the tables of a data directory, with their SQL."""
