"""Conversation-corpus quality, sampling, sizing and judging on Spark DataFrames."""

from convq.functions.rules import CLASSIC, OPTIMIZED, Profile

__all__ = ["CLASSIC", "OPTIMIZED", "Profile"]
