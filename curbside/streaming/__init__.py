from curbside.streaming.current import current_table, tagged
from curbside.streaming.incremental import current_matches, follow_matches, start_incremental
from curbside.streaming.jobs import (
    start_cell_members,
    start_latest,
    start_matching,
    start_member_changes,
    start_transitions,
)
from curbside.streaming.ledger import Ledger
from curbside.streaming.members import fold_members, member_changes
from curbside.streaming.movement import correct_cells, fold_transitions, follow_cells, live_counts
from curbside.streaming.sinks import all_batches, commit, last_batch, print_batches, write_batches

__all__ = [
    "Ledger", "all_batches", "commit", "correct_cells", "current_matches", "current_table", "fold_members", "fold_transitions", "follow_cells", "follow_matches",
    "last_batch", "live_counts", "member_changes", "print_batches", "start_cell_members", "start_incremental", "start_latest",
    "start_matching", "start_member_changes", "start_transitions", "tagged", "write_batches",
]
