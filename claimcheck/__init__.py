"""Claim verification and dataset profiling over Spark DataFrames."""

from claimcheck.session import ClaimSession

__all__ = ["ClaimSession"]
