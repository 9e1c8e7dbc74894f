"""Training-data operators. Queries: ``llm.queries``; the pipeline: ``corpus_pipeline``."""
