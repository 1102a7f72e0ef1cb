"""Stateful streams and ordered folds."""
