"""Writers: snapshots, exports and the catalog of datasets, runs and transforms."""
