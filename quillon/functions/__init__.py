"""Column expressions: text, codecs, ordinals."""
