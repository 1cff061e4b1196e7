"""From tree to Columns."""
