"""Session helpers and composite pipelines."""
