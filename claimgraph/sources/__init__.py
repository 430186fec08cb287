"""Readers and writers of the files claims come from and go to."""
