"""Sources: embedding banks and corpora."""
