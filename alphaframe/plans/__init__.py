"""Multi-operator plans: feature panel, walk-forward scoring, strategies, and the query catalog."""
