"""Session settings, shared-folder tables and the registered queries."""
