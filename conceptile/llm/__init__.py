"""Training-data operators: sharding, sanitising, deduplication, counting, scoring, mixing, rules, language, archives, decontamination."""
