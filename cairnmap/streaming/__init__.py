"""Incremental forms: votes of runs that arrive one after another."""
