"""Readers and writers: landing files, JSON events, quarantine, curated and warehouse tables."""
