"""Pose-similarity analytics on Spark."""
