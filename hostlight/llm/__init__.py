"""Operators for preparing training text at corpus scale; each module holds one operator."""
