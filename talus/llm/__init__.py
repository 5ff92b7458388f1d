"""Corpus preparation for language-model training: ten operators over whole tables."""
