"""Source tables, the evidence catalog and the change producers."""
