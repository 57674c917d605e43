"""Selection steps. A step never changes a text or the order; it marks rows as dropped.

Frames carry `_gone`: null while a document is kept, else twice the number of
the step that dropped it, plus one where the step tells two reasons apart.  One
aggregate over the final frame then gives every step's counts, without
accumulators that a retried task would count twice.
"""
