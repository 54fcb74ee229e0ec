"""DataFrame operators over code-knowledge facts."""
