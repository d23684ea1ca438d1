"""Readers and writers of tensor archives."""
