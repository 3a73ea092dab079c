"""Operators on columns: everything here stays within what the optimiser sees."""

from .native import entries, flat_map, global_reduce, map_ordered, ring_reduce, route, routed, tagged
from .loops import Checkpoint, fold, row_loop, supersteps

__all__ = ["Checkpoint", "entries", "flat_map", "fold", "global_reduce", "map_ordered", "ring_reduce", "route", "routed", "row_loop", "supersteps", "tagged"]
