"""What the engine computes: line items, metrics and rules, as Python data and column functions.

Adding a metric or rule is adding an entry; its formula is a function of the grid's columns.
"""
