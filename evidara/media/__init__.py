"""File-level measurements where bytes must be decoded; each is a pandas UDF over binary or image columns."""
