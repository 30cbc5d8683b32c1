"""Operators for preparing training data. Nothing outside this folder imports it, and each module stands alone but for the ``_`` helpers."""
