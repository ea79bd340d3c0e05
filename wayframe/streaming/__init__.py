"""Stateful operators over vehicle positions, in batch and as streams."""
