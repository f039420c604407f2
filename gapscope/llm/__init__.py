"""Training-data operators: tokens, language models, near duplicates, extraction, scans."""
