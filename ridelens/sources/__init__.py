"""Trip records in (test-table adapter, CSV trip files) and result extracts out."""
