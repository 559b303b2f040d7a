"""Scalar detection: context scores, checksums and the registered detectors."""
