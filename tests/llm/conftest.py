import importlib.util
import os

# The fixture of the parent folder serves here too.
spec = importlib.util.find_spec("folio.llm")
collect_ignore = [] if spec else [f for f in os.listdir(os.path.dirname(__file__)) if f.startswith("test_")]
