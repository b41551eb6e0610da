"""Where datasets, catalogs and configurations come from, and where results go."""
