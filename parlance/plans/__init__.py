"""Multi-stage plans: distributed global rank, skew-safe prefix scans, registered queries."""
