"""Driver-side plans: models of an export, queries, the export itself."""
