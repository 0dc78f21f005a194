"""Reading tables and publishing snapshots."""
