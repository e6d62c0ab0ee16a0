"""The package's query modules."""

import importlib

MODULES = [importlib.import_module(f"netloom.llm.{m}") for m in ("p2_vocabulary", "p3_encoding", "p6_packing", "p7_mixing", "p8_sentences")]
