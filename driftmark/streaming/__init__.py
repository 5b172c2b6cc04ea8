"""Streams.

The analytics have no stateful stream operator. The row-wise ones (`classify_pairs`,
`customer_segment`, `nearest_centre`, and scoring with a fitted model) are plain projections, so
they take a streaming DataFrame as they take a static one; `tests/test_streaming.py` runs them
that way.
"""
