"""Operators of a training-data pipeline: deduplication, packing, scoring, language, decontamination, shards, chats, rules, HTML."""
