"""Names and instants that every part agrees on."""

from datetime import datetime

#: The end of time in all results.
INFINITY = datetime(2260, 12, 31, 23, 59, 59)
INFINITY_TIMESTAMP = INFINITY
#: Inputs from here on, and results from the second on, mean the end of time.
INPUT_LIMIT, OUTPUT_LIMIT = datetime(9999, 1, 1), datetime(2262, 4, 1)
#: A row that ends in this year or later counts as open-ended.
OPEN_YEAR = 2200
EF, ET, AF, AT = "effective_from", "effective_to", "as_of_from", "as_of_to"
TEMPORAL = (EF, ET, AF, AT)
HASH = "value_hash"
#: Tells the rows of both results apart where they are one table.
CHANGE = "change"
DELTA, FULL_STATE = "delta", "full_state"
MODES = (DELTA, FULL_STATE)
ALGORITHMS = {"xxhash": "xxhash", "xx": "xxhash", "sha256": "sha256", "sha": "sha256"}
