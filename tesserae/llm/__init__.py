"""Training-data operators: dedup, joins, search, tokens, sharding and packing.

Nothing outside this folder imports it; ``queries`` lists its driver queries.
"""
