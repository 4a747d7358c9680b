"""Operators for large-scale training-data pipelines; nothing else in turnlake imports this."""
