"""Runs: requests, folders, protocol, stages."""
