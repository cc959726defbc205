"""Size bounds that broadcasts rely on."""

# A table with one row per date has at most 3,652,059 rows (all values of DATE), some 100 MB with a
# few doubles; tables keyed by date alone are therefore always small enough to broadcast.
MAX_DATES = 3_652_059
