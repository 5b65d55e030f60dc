"""No streaming operators.

The capability this package covers has no stream, watermark or late data.  The
keyed operators of :mod:`unitcal.operators.series` are plain DataFrame functions,
so they can be called on a micro-batch from ``foreachBatch``.
"""
