"""Column functions: text helpers, summaries, citations, query understanding, labels."""
