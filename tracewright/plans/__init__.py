"""What a physical plan does: its joins, exchanges and scans, for checks before a job runs at scale."""
