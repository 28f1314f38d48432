"""Change sets from a stream of updates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from chronolith.engine import compute_changes
from chronolith.operators.apply import apply_change_set, is_live


def maintain(
    updates: DataFrame, load: Callable[[SparkSession], DataFrame], store: Callable[[DataFrame, int], None],
    id_columns: Sequence[str], value_columns: Sequence[str], **options,
) -> DataStreamWriter:
    """Apply each micro-batch to the stored table.

    ``load`` reads the table; ``store`` replaces it and is told the batch number, so a batch that is run again
    after a failure can be seen as such and stored once. Changes are computed for the rows that are known now; those that
    earlier batches ended stay as they are. Options are those of ``compute_changes``.
    """

    def step(batch: DataFrame, number: int) -> None:
        table = load(batch.sparkSession)
        current, past = table.where(is_live(table)), table.where(~is_live(table))
        changes = compute_changes(current, batch, id_columns, value_columns, **options)
        now = apply_change_set(current, changes, id_columns)
        store(now.unionByName(past.select(*now.columns)), number)

    return updates.writeStream.foreachBatch(step)
