"""Column expressions: identity codecs, text canonical forms, fixed vocabularies."""
