"""Shared building blocks: ranks, interval joins, groups, statistics, special functions."""
