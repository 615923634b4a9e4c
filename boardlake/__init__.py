"""Leaderboard, roster and retrieval analytics as Spark jobs."""
