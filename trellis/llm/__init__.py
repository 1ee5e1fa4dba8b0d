"""Operators for large-scale training-data pipelines. Nothing else in trellis imports this package."""
