"""Conversation-memory analytics on Spark: ledgers, projections, folds, retrieval and packing as DataFrame plans."""
