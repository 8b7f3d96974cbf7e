"""Operators for preparing large text corpora, each usable alone; nothing else in the package imports them."""
