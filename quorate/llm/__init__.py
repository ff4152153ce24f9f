"""Operators for training data: consensus, sampling, overlap, clusters, defects,
abuse, look-alikes, token ids, mixing and garbled text.

Nothing outside this subpackage imports it.
"""
