"""Training-data operators: one module for each, sharing only :mod:`rowlens.llm.common`."""
