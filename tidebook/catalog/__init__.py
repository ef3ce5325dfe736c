"""Every operator bound to the given tables, with the SQL it is checked against."""
import importlib
import pkgutil

from tidebook.catalog import views  # noqa: F401  (views must exist before the query modules load)
from tidebook.catalog.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
