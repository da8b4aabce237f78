"""Readers, the star-schema adapter, schema checks and sinks."""
