"""Keys a plan module registers: python tools/keys.py text review"""
import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from folioscope.plans import registry  # noqa: E402

for name in sys.argv[1:]:
    importlib.import_module(f"folioscope.plans.{name}_queries")
print(" ".join(registry.QUERIES))
