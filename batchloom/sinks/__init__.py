"""Writers for tables and control files."""
