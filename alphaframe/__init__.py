"""Spark-native cross-sectional panel research.

Every public function takes and returns DataFrames; nothing here keeps a session.
"""
