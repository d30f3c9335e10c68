"""Readers and writers of prompts, results, summaries, scoring sheets and checkpoints."""
