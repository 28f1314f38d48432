"""A Spark-native engine for bitemporal change sets."""

from chronolith.constants import INFINITY_TIMESTAMP
from chronolith.engine import BitemporalProcessor, ChangeSet, compute_changes
from chronolith.functions.hashing import add_hash_key, with_value_hash
from chronolith.operators.apply import apply_change_set, apply_changes, as_of

__all__ = ["INFINITY_TIMESTAMP", "BitemporalProcessor", "ChangeSet", "add_hash_key", "apply_change_set", "apply_changes", "as_of", "compute_changes", "with_value_hash"]
