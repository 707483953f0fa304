"""Page requests and cursors, compiled to predicates."""
