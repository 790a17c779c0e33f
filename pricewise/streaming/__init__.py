"""Intentionally empty.

The analyses this package rebuilds read two complete tables once; they have no
stream, watermark, time window or state, so no streaming operator is provided.
Every operator is a DataFrame -> DataFrame function and can be applied inside
``foreachBatch`` of a Structured Streaming query if a caller needs that.
"""
