"""Driver-side descriptions: fixed values, feature plans, time windows."""
