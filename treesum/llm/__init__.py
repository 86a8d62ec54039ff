"""Operators for large text and vector corpora; nothing else in treesum imports this subpackage."""
