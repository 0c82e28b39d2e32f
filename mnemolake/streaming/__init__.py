"""Structured Streaming: subscriptions, incremental folds, state with a time limit."""
