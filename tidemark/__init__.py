"""Point-in-time panels and tail-risk evaluation on Spark."""
