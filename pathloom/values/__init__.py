"""Value algebra on Columns."""
