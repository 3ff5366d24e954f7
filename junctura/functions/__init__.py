"""Column functions and checks that the operators share."""

from .columns import cell_name, event_name, excluded, inclusion_ratio, row_name, splice_key, strand_sign
from .ordering import adjusted, first_seen_index, measured, shared_folder, spread, staged, staged_numbers, with_index

__all__ = ["adjusted", "cell_name", "event_name", "excluded", "first_seen_index", "inclusion_ratio", "measured", "row_name", "shared_folder", "splice_key", "spread", "staged", "staged_numbers", "strand_sign", "with_index"]
