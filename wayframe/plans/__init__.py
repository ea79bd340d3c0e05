"""Batch plans: loading, estimators, catalogue, routing, audits."""
