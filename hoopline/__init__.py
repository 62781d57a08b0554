"""Spark jobs over basketball play-by-play: feeds, game states, probability models."""
