"""Operators for large text corpora: cleaning, deduplication, decontamination, tokens and chats."""
