"""Operators of a training-data pipeline: extraction, deduplication, scanning, scoring, selection, packing.

Nothing else in the library imports this package. Every operator takes DataFrames and returns a DataFrame; rows with equal
`doc_id` and text are one document and share one answer, rows with equal `doc_id` and other text are documents of their own.
"""
