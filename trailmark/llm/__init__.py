"""Operators of a training-data pipeline: each reads whole tables and returns whole results."""
