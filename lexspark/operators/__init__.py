"""Models, added vocabulary and encodings."""
