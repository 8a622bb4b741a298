"""Operators for large training corpora: sharding, mixing, packing, filters, joins and near-duplicate search.

Nothing outside this subpackage imports it; `registry` lists its queries.
"""
