"""Training-data operators: fixity, sharding, filtering, mixing, packing, fingerprints, token files.

Nothing outside this subpackage imports it.
"""
