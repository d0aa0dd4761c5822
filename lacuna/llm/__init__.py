"""Operators for building training data: counting, sharding, deduplicating, formatting, joining, packing, searching and sniffing.

Nothing outside this subpackage imports it. Each module keeps one operator with its
own general interface; ``queries`` holds the thin registered queries and their SQL.
"""
