"""Relational operators: pairs, signals, fusion, evaluation, graph, evidence."""
