"""Decoders that turn files into typed rows; Python touches bytes only here and in the sinks."""
