"""Spark DataFrame operators for data-change, segmentation and series analytics."""
