"""Names of the queries registered by one plans module."""
import importlib, os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tickloom.plans.catalog import CATALOG
importlib.import_module(f"tickloom.plans.{sys.argv[1]}")
print(" ".join(CATALOG))
