"""Plan helpers shared by operators: tables, lineage cuts, code on executors."""

from tilewright.plans.cut import cut, forget, shared_dir
from tilewright.plans.ship import map_arrow, ship
from tilewright.plans.tables import table

__all__ = ["cut", "forget", "map_arrow", "shared_dir", "ship", "table"]
