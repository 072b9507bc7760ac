"""Operators for preparing training text. Nothing else in colloquy imports this package."""
