"""Transcription-corpus analytics on Spark: storing, reviewing, validating and measuring text corpora."""
