"""Joins, aggregates and rules over segments, frames, timelines and answers."""
