"""Where rows come from: the catalog with its snapshots, and comma-separated files."""
