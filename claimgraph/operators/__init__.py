"""Bulk operators over claim frames."""
