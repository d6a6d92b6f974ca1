"""Writers of plain files."""
