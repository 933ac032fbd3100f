"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Each module holds one operator with
its general interface; ``queries`` binds them to the tables with production
parameters and ``oracles`` holds the SQL that states the same results.
"""
