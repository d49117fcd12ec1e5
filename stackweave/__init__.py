"""A Spark-native engine for personal literature collections.

Everything is a plan over DataFrames: sources and sinks in ``sources``, relational and
library operators in ``operators``, scalar and text functions in ``functions``, views and
schema conversions in ``plans``, stateful behaviour in ``streaming``.
"""
