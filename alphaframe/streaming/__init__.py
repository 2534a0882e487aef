"""Structured Streaming twins of the order, fill and smoothing operators."""
