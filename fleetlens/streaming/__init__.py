"""Reports that are kept up to date from a stream of snapshots."""
