"""Composed jobs and plan-shape checks."""
