"""The row-wise cleaning rules on arriving files."""
