"""Every query over the given tables; importing this package registers them all."""

from importlib import import_module
from pkgutil import iter_modules

from tidemark.plans.registry import QUERIES, SQL, Tables, bind

for _module in iter_modules(__path__):
    import_module(f"{__name__}.{_module.name}")

__all__ = ["QUERIES", "SQL", "Tables", "bind"]
