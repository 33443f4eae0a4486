"""Operators for preparing training text: quality, packing, fingerprints, licences, duplicates, URLs, pages, mixing."""
