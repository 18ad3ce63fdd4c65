"""Writers of artifacts, snapshots and exports."""
