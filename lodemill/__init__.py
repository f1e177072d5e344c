"""Evidence retrieval, workspace state and corpus preparation as DataFrame operators."""
