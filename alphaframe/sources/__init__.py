"""Readers, payload flatteners, and the panel store."""
