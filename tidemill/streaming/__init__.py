"""Structured Streaming over event tables. An extension: snapshots and queries need none of it."""
