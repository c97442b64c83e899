"""Operators of the media library: ingest, matching, review, ratings, listing, learning, ranking."""
