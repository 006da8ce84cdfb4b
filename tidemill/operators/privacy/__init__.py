"""Finding, resolving and replacing personal data in texts and columns."""
