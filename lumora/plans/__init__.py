"""Shared plan shapes: ordered positions, blocked windows, exact quantiles, normal equations."""
