"""Shared plumbing: sessions, shared storage, skew-aware joins and components."""
