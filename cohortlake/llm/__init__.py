"""Training-data operators: filters, scorers, joins, packing and token files over document tables.

Nothing outside this subpackage imports it.
"""
