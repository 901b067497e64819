"""Operators that prepare training text at scale; nothing outside this folder imports them."""
