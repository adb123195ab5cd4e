"""Operators of a training-data pipeline; nothing else in seqspark imports this subpackage."""
