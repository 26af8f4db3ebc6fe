"""The questions: mart build, KPIs, series, leaderboards, map, insights, pairs."""
