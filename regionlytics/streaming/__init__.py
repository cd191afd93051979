"""Streams: batches of mutations into a model, and clusters of events in time."""
