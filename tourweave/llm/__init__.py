"""Training-data operators: ten stand-alone operators and the queries that apply them.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface plus the thin ``opN_*`` query that ``registry`` registers.
"""
