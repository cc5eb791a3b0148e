"""Training-data operators: deduplication, packing, decontamination, quality, chat, media, secrets and URL filters.

Nothing outside this subpackage imports it.
"""
