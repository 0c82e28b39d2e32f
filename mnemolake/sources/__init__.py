"""Tables, logs, snapshots and versioned manifests."""
