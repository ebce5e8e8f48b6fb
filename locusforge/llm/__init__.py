"""Operators on text corpora: archives, secrets, near duplicates, mixtures, languages, quality, pages, benchmarks, chats."""
