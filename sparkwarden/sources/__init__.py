"""Reading, checking, normalising and storing audit logs."""
