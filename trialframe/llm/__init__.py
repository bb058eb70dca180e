"""Operators for preparing training corpora: filtering, deduplication, mixing, packing, archives."""
