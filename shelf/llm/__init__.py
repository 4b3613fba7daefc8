"""Operators for preparing training text: filtering, deduplication, decontamination, counting, mixing."""
