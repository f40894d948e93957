"""Compositions of operators: listings, stored leaderboards, a refresh run."""
