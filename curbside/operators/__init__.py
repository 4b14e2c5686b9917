from curbside.operators.movement import (
    cell_deltas,
    cell_members,
    cell_stats,
    moved_taxis,
    transitions,
    with_moved_flag,
)
from curbside.operators.neighbours import merge_lists, nearest
from curbside.operators.state import latest, with_previous
from curbside.operators.radius import within

__all__ = [
    "cell_deltas", "cell_members", "cell_stats", "latest", "merge_lists", "moved_taxis", "nearest", "transitions",
    "with_moved_flag", "with_previous", "within",
]
