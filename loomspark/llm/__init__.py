"""Operators of a training-data pipeline over document and embedding tables.

Nothing outside this subpackage imports it. Each ``opN`` module holds one operator with its general interface, its
``opN_<name>(spark, sf_dir)`` query and, where SQL can express the result, its ``ORACLE_SQL``.
"""
