"""DataFrame → DataFrame operators: reshape, joins, stats, ML, weather, features."""
