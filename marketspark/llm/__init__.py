"""Operators of a training-data pipeline: chat formatting, deduplication, filters, packing, scoring, sharding."""
