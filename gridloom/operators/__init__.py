"""DataFrame -> DataFrame operators, chainable with ``DataFrame.transform``.

Pixel tables have columns ``y``, ``x`` and payload columns; class columns are
integers; patches are rows ``patch_id, y0, x0``.
"""
