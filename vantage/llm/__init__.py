"""Training-data operators on Spark: each module holds one operator, ``queries`` the registered queries.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library whole.
"""
