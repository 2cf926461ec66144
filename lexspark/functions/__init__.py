"""Column builders: normalizers, splits and decoders."""
