"""Tidewright: rules, decisions, derivations and event-time state as Spark DataFrames."""
