"""Reusable plan shapes: staging, distributed ordering, neighbour joins."""
