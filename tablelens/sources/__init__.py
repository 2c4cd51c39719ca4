"""Readers, sinks, sampling and fingerprints."""
